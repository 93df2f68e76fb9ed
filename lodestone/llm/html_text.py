"""Main text of web pages by composite text density.

Each page is parsed into a tree, leniently. Subtrees that are never content are
set aside: elements such as scripts, forms, menus and asides, and those that call
themselves a menu, footer, sidebar, notice, advert or reader comments, unless all
that the page has of a heading, an article or text is in there. For every other node the characters, link characters, tags and link tags below it
give its composite text density. The node with the largest sum of its children's
densities, of parts that are more than pieces of a paragraph, is the centre of
the article; the least density on the path from it up to body is the threshold
that its neighbours on the path must reach to belong. article and main are nodes
like any other.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.runtime import tune

#: A tag's attributes: quotes count behind = only, as in browsers.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+|(?=>|\Z)))*+)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/][^\s=/]*+)(?:\s*+=\s*+(\"[^\"]*+\"?|'[^']*+'?|[^\s]*+))?")
_NAMED = frozenset("class id role hidden".split())

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp noframes".split())
_BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section
    summary table tbody tfoot thead tr ul""".split()
)
#: What an opening tag closes, up to the given boundary.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
}
_NEVER = frozenset(
    """script style noscript template head title iframe object embed svg canvas audio video form button select
    input textarea label fieldset nav aside footer menu dialog search xmp noframes""".split()
)
#: Names of what an article is without: comments, and menus, page heads and footers, sidebars, notices, adverts.
_COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|respond|replies|disqus)(?:$|[\s_-]|\d)", re.I)
_LINKS = re.compile(r"(?:^|[\s_-])(?:menu|nav|navbar|navigation|breadcrumbs?|pagination|pager)(?:$|[\s_-]|\d)", re.I)
_NOISE = re.compile(
    r"(?:^|[\s_-])(?:masthead|footer|contentinfo|sidebar|side-bar|complementary|"
    r"cookies?|consent|gdpr|notices?(?![\s_-]?boards?)|notification|ads?|advert\w*|adsense|sponsored)(?:$|[\s_-]|\d)",
    re.I,
)
#: Parts of a paragraph: they make no node the centre.
_INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd mark q s small span strong sub sup time tt u var".split())
_HEADING = ("h1", "main", "article")
_HEAD = frozenset("h1 h2 h3 h4 h5 h6 header hgroup".split())


class _Node:
    __slots__ = ("chars", "density", "depth", "kids", "link_chars", "link_tags", "name", "parent", "skip", "sum", "tag", "tags")

    def __init__(self, tag: str, parent: _Node | None, skip: bool = False, name: str = ""):
        self.tag, self.parent, self.skip, self.name, self.kids = tag, parent, skip, name, []
        self.depth = parent.depth + 1 if parent is not None else 0
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.density = self.sum = 0.0


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for k, v in _ATTRIBUTE.findall(text) if text and not text.isspace() else ():
        if k.lower() in _NAMED:
            found.setdefault(k.lower(), v.strip("\"'"))
    return found


def _excluded(tag: str, text: str, inside_article: bool) -> tuple[bool, str]:
    """Whether an element is never content, and by what name ("" where it is by its kind; "links" in an article, where its links decide)."""
    if tag in _NEVER or tag == "header" and not inside_article:
        return True, ""
    if tag in ("html", "body", "article", "main"):
        return False, ""
    a = _attributes(text)
    names = [a.get(k, "") for k in ("class", "id", "role")]
    links = any(map(_LINKS.search, names))
    name = "comments" if any(map(_COMMENTS.search, names)) else "noise" if any(map(_NOISE.search, names)) or a.get("role") == "banner" or links and not inside_article else "links" if links else ""
    return "hidden" in a or bool(name), "" if "hidden" in a else name


def _settle(node: _Node) -> None:
    """Of an article's own part that calls itself a menu: set it aside only if at least half of its characters are links."""
    chars = links = 0
    stack = [(node, node.tag == "a")]
    while stack:
        x, inside = stack.pop()
        for k in x.kids:
            if isinstance(k, str):
                n = len("".join(k.split()))
                chars, links = chars + n, links + n * inside
            elif not k.skip or k.name:
                stack.append((k, inside or k.tag == "a"))
    node.skip, node.name = 2 * links >= chars, ""


def _reconsider(root: _Node) -> None:
    """Where no heading or article is outside of what was set aside by name, take back what holds one, or, comments aside, most of the text."""
    nodes, stack, outside = [], [(root, False)], False
    while stack:
        node, aside = stack.pop()
        if not node.skip or node.name:
            aside = aside or node.skip
            outside = outside or not aside and node.tag in _HEADING
            nodes.append(node)
            stack += [(k, aside) for k in node.kids if isinstance(k, _Node)]
    if outside or not any(n.name for n in nodes):
        return
    heads, chars = {}, {}
    for node in reversed(nodes):
        kids = [id(k) for k in node.kids if isinstance(k, _Node) and id(k) in chars]
        chars[id(node)] = sum(len(k) for k in node.kids if isinstance(k, str)) + sum(chars[k] for k in kids)
        heads[id(node)] = node.tag in _HEADING or any(heads[k] for k in kids)
    for node in nodes:
        if node.name == "noise" and (heads[id(node)] or 2 * chars[id(node)] > chars[id(root)]):
            node.skip = False


def parse(page: str) -> _Node:
    """The page as a tree of nodes whose kids are strings and nodes."""
    root = _Node("#root", None)
    open_, at = root, 0
    there: dict[str, list[_Node]] = {}  # open nodes of each tag, the innermost last
    menus: list[_Node] = []

    def close(to: _Node) -> None:
        nonlocal open_
        while open_ is not to:
            there[open_.tag].pop()
            open_ = open_.parent

    def nearest(tags) -> _Node | None:
        """The innermost open node of these tags."""
        return max((there[t][-1] for t in tags if there.get(t)), key=lambda n: n.depth, default=None)

    size = len(page)
    while at < size:
        found = _TOKEN.search(page, at)
        if found is None:
            open_.kids.append(page[at:])
            break
        if found.start() > at:
            open_.kids.append(page[at : found.start()])
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1]:
            up = nearest((tag,))
            if up is not None and tag not in ("html", "body") and (tag in _BLOCK or (bar := nearest(_BARRIERS)) is None or bar.depth <= up.depth):
                close(up.parent)
            continue
        if tag in ("html", "body") and there.get(tag):
            continue
        if tag in _BLOCK:
            up = nearest(_PARAGRAPH)
            if up is not None and up.tag == "p":
                close(up.parent)
        if tag == "body" and there.get("head"):
            close(there["head"][-1].parent)
        if tag in _CLOSES:
            these, bound = _CLOSES[tag]
            up = nearest(these | bound)
            if up is not None and up.tag in these:
                close(up.parent)
        node = _Node(tag, open_, *_excluded(tag, found[3], bool(there.get("article") or there.get("main"))))
        open_.kids.append(node)
        if node.name == "links":
            menus.append(node)
        if tag in _RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else size
        elif tag not in _VOID and not _self_closed(found[3]):
            open_ = node
            there.setdefault(tag, []).append(node)
    for node in reversed(menus):
        _settle(node)
    _reconsider(root)
    return root


_BARRIERS = ("table", "article", "main", "body")
_PARAGRAPH = ("p", "td", "th", "li", "article", "body", "div")


def _self_closed(attributes: str) -> bool:
    """Whether a tag ends in a slash that is no part of a value without quotes."""
    if not attributes.endswith("/"):
        return False
    last = attributes.split()[-1]
    return "=" not in last or last[-2:-1] in ("\"", "'")


def _path(node: _Node | None):
    while node is not None:
        yield node
        node = node.parent


def _ordered(root: _Node) -> list[_Node]:
    """Nodes that may be content, parents before their kids."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if not node.skip:
            out.append(node)
            stack += [k for k in reversed(node.kids) if isinstance(k, _Node)]
    return out


def measure(root: _Node) -> list[_Node]:
    """Set counts, composite densities and density sums of all nodes that may be content."""
    nodes = _ordered(root)
    for node in reversed(nodes):
        node.chars = sum(len("".join(html.unescape(k).split())) for k in node.kids if isinstance(k, str))
        node.tags = node.link_chars = node.link_tags = 0
        for k in node.kids:
            if isinstance(k, _Node) and not k.skip:
                node.chars += k.chars
                node.tags += k.tags + 1
                node.link_chars += k.link_chars
                node.link_tags += k.link_tags + (k.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    body = next((n for n in nodes if n.tag == "body"), root)
    share = body.link_chars / max(body.chars, 1)
    for node in nodes:
        if not node.chars:
            continue
        plain = max(node.chars - node.link_chars, 1)
        base = math.log(node.chars / plain * node.link_chars + share * node.chars + math.e)
        ratio = node.chars / max(node.link_chars, 1) * max(node.tags, 1) / max(node.link_tags, 1)
        node.density = node.chars / max(node.tags, 1) * max(math.log(ratio) / math.log(max(base, math.e)), 0.0)
    for node in nodes:
        node.sum = sum(k.density for k in node.kids if isinstance(k, _Node) and not k.skip and k.tag not in _INLINE)
    return nodes


def _select(root: _Node) -> list[_Node]:
    nodes = measure(root)
    if not any(n.chars for n in nodes):
        return []
    body = next((n for n in nodes if n.tag == "body"), root)
    best = max((n for n in _ordered(body) if n.chars), key=lambda n: n.sum, default=body)
    if best.sum == 0.0:
        best = body
    path = list(_path(best))
    path = path[: path.index(body) + 1]
    # Neighbours along the path that are as dense as the path itself belong.
    least = min((n.density for n in path if n.density > 0), default=0.0)
    chosen = {id(best)}
    for node in path[:-1]:
        for k in node.parent.kids:
            if isinstance(k, _Node) and k is not node and not k.skip and (k.tag in _HEAD or k.density >= least):
                chosen.add(id(k))
    out, stack = [], [body]
    while stack:
        node = stack.pop()
        if id(node) in chosen:
            out.append(node)
        else:
            stack += [k for k in reversed(node.kids) if isinstance(k, _Node) and not k.skip]
    return out


def _blocks(node: _Node) -> list[str]:
    out: list[list[str]] = [[]]
    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            out.append([])
        elif isinstance(x, str):
            out[-1].append(html.unescape(x))
        elif x.tag in ("br", "td", "th"):
            out[-1].append(" ")
            stack += reversed(x.kids)
        elif not x.skip:
            if x.tag in _BLOCK:
                out.append([])
                stack.append(None)
            stack += reversed(x.kids)
    return [t for t in (" ".join("".join(b).split()) for b in out) if t]


def main_text(page: str | None) -> str:
    """Blocks of the article in page order, joined by two line feeds; empty for null, empty or text-free pages."""
    if not page:
        return ""
    return "\n\n".join(b for node in _select(parse(page)) for b in _blocks(node))


def _extract(batches):
    for batch in batches:
        text = [main_text(h) for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of pages; whole pages, no cap.

    Null, empty and text-free pages give an empty text. Repeated rows and null
    ids are kept as they are; other columns of pages are not read.
    """
    tune(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars bigint")
