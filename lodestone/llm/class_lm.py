"""Brown class-based n-gram model: exchange clustering, class transitions, word emissions.

Every word with OFTEN or more training tokens is an item of its own; the others
share items by how they end. Items, and with them tail buckets and classes, grow
with the training vocabulary. Exchange clustering moves items between classes
while the likelihood of the class bigrams rises: first the TOP most frequent
words, the others following their endings, by one dense table; then every item,
in windows that run side by side from the class bigrams of the round before. A
text's probability is the product over its tokens of the class transition and
the word's emission from its class, both smoothed. The emission keeps one share
per class for words never seen, so each distribution sums to one.

The corpus passes: (1) blocks of documents are coded against a dictionary of
their own, and both are written; the dictionary's words are dealt to buckets by
their hash; (2) each bucket adds up its words' counts from all blocks, numbers
its items and answers every block with the counts that it could not know itself
and the items; (3) blocks take their answers in and are written as items and
counts; (4) bigrams of the first items are counted block by block; (5) in each
round, class bigrams and each item's sparse counts of neighbouring classes;
(6) each block is scored. No vocabulary is ever in one place; the driver holds a
count and a class for each item, and no words beyond that.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.runtime import input_bytes, materialize, remainder, tune

OFTEN = 10  # training tokens that make a word an item of its own
TOP = 512  # words that are clustered first
TAILS = 512  # items for all other words, by their last two characters: so many at least, and while the first words are clustered
CLASSES = 48  # at least
ROUNDS = 6  # of the first words
EXCHANGES = 2  # rounds of all items
BLOCK = 4 << 20  # bytes of text coded together
BOUNDARY = TOP + TAILS  # among the first items, the one before a text's first token and of its end token
FIRST = BOUNDARY + 1
BACKOFF = 5.0  # weight of the class unigram in a transition
MERGE = 1 << 22  # sparse counts that a task gathers before it hands them on

_END = b""  # no word is empty, so this stands for the end of a text


def words_of(text: bytes) -> list[bytes]:
    """The tokens of a text: lower-cased words, then one end."""
    return [*text.lower().split(), _END]


def tail_of(word: bytes) -> int:
    """Sixteen bits for the last two characters of a word; its tail item is their remainder."""
    return zlib.crc32(word[-8:].decode("utf-8", "ignore")[-2:].encode()) & 0xFFFF


def sizes(items: int) -> tuple[int, int]:
    """Tail items, a power of two, and classes for so many words that are items of their own."""
    return min(1 << 16, max(TAILS, 1 << (items // 64).bit_length())), max(CLASSES, int(2 * items ** (1 / 3)))


_CODED = pa.schema([
    ("bucket", pa.int32()), ("block", pa.int64()), ("words", pa.binary()), ("at", pa.binary()), ("n", pa.binary()), ("end", pa.int32()),
    ("tails", pa.binary()), ("doc_id", pa.binary()), ("size", pa.binary()), ("held", pa.binary()), ("codes", pa.binary()),
])
_CODED_DDL = "bucket int, block bigint, words binary, at binary, n binary, end int, tails binary, doc_id binary, size binary, held binary, codes binary"


def _coder(buckets: int):
    """Blocks of documents: one row with the coded texts, and one for each bucket of the block's dictionary."""

    def code(batches):
        part, number = TaskContext.get().partitionId(), 0
        ids: list = []
        texts: list[bytes] = []
        held: list[int] = []  # whether it is held out, and 2 more where there is no id
        load = 0
        for batch in batches:
            for doc_id, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
                if texts and load + len(text) > BLOCK:
                    yield _block((part << 32) + number, ids, held, texts, buckets)
                    ids, texts, held, load, number = [], [], [], 0, number + 1
                ids.append(doc_id or 0)
                held.append(h + 2 * (doc_id is None))
                texts.append(text)
                load += len(text)
        if texts:
            yield _block((part << 32) + number, ids, held, texts, buckets)

    return code


def _block(block: int, ids: list, held: list, texts: list[bytes], buckets: int) -> pa.RecordBatch:
    code: dict[bytes, int] = {}
    sizes, parts = [], []
    for text in texts:
        words = words_of(text)
        sizes.append(len(words))
        parts.append(np.fromiter((code.setdefault(w, len(code)) for w in words), np.int32, len(words)))
    codes, sizes, held = np.concatenate(parts), np.array(sizes, np.int64), np.array(held, np.uint8)
    words = list(code)
    n = np.bincount(codes[np.repeat(held & 1 == 0, sizes)], minlength=len(words))
    tails = np.fromiter(map(tail_of, words), np.uint16, len(words))
    rows = [{
        "block": block, "end": code[_END], "tails": tails.tobytes(), "doc_id": np.array(ids, np.int64).tobytes(), "size": sizes.tobytes(),
        "held": held.tobytes(), "codes": codes.astype(np.uint16 if len(words) <= 1 << 16 else np.uint32).tobytes(),
    }]
    bucket = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % np.uint32(buckets)
    order = np.argsort(bucket, kind="stable").astype(np.int32)
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for i in np.flatnonzero(np.diff(cut)).tolist():
        mine = order[cut[i] : cut[i + 1]]
        rows.append({"bucket": i, "block": block, "words": b"\n".join([words[j] for j in mine.tolist()]), "at": mine.tobytes(), "n": n[mine].astype(np.uint32).tobytes()})
    return pa.RecordBatch.from_pylist(rows, _CODED)


_ANSWER = pa.schema([
    ("bucket", pa.int32()), ("block", pa.int64()), ("at", pa.binary()), ("c", pa.binary()), ("own", pa.binary()),
    ("items", pa.binary()), ("tails", pa.binary()), ("end", pa.int64()), ("tail", pa.int32()), ("n", pa.int64()), ("kinds", pa.int64()),
])
_ANSWER_DDL = "bucket int, block bigint, at binary, c binary, own binary, items binary, tails binary, end bigint, tail int, n bigint, kinds bigint"


def _add_up(rows: pa.Table) -> pa.Table:
    """One bucket's counts: answers to its blocks, its items in order of frequency, the end token, and sums of the other words by their ending."""
    total: dict[bytes, int] = {}
    bucket = rows.column("bucket")[0].as_py()
    parts = [(r["block"], r["words"].split(b"\n"), np.frombuffer(r["at"], np.int32), np.frombuffer(r["n"], np.uint32)) for r in rows.to_pylist()]
    for _, words, _, n in parts:
        for w, k in zip(words, n.tolist()):
            total[w] = total.get(w, 0) + k
    ends = total.get(_END, 0)
    own = sorted(((w, c) for w, c in total.items() if c >= OFTEN and w != _END), key=lambda x: (-x[1], x[0]))
    number = {w: i for i, (w, _) in enumerate(own)}
    out = []
    for block, words, at, n in parts:
        c = np.fromiter((total[w] for w in words), np.int64, len(words))
        mine = np.fromiter((number.get(w, -1) for w in words), np.int32, len(words))
        more = (c != n) | (mine >= 0)
        if more.any():
            out.append({"bucket": bucket, "block": block, "at": at[more].tobytes(), "c": c[more].tobytes(), "own": mine[more].tobytes()})
    tails = np.fromiter((tail_of(w) for w, _ in own), np.uint16, len(own))
    out.append({"bucket": bucket, "items": np.array([c for _, c in own], np.int64).tobytes(), "tails": tails.tobytes(), "end": ends})
    rare = {w: c for w, c in total.items() if 0 < c < OFTEN and w != _END}
    tail = np.fromiter(map(tail_of, rare), np.int64, len(rare))
    n, kinds = np.bincount(tail, np.fromiter(rare.values(), np.int64, len(rare))), np.bincount(tail)
    out += [{"tail": i, "n": int(n[i]), "kinds": int(kinds[i])} for i in np.flatnonzero(kinds).tolist()]
    return pa.Table.from_pylist(out, _ANSWER)


_READ = pa.schema([(k, pa.binary()) for k in ("doc_id", "size", "held", "codes", "item", "first", "c")])
_READ_DDL = "doc_id binary, size binary, held binary, codes binary, item binary, first binary, c binary"


class _Coded:
    """A block's texts as items and counts."""

    def __init__(self, row: dict):
        read = lambda k, t: np.frombuffer(row[k], t)
        self.ids, self.size, self.held = read("doc_id", np.int64), read("size", np.int64), read("held", np.uint8) & 1 == 1
        self.no_id = read("held", np.uint8) > 1
        self.codes = read("codes", np.uint16 if len(row["codes"]) == 2 * self.size.sum() else np.uint32)
        self.starts = np.r_[0, np.cumsum(self.size)[:-1]]
        self.learned = np.repeat(~self.held, self.size)
        self.item, self.first, self.c = read("item", np.int32), read("first", np.int16), read("c", np.int64)

    def pairs(self, kind: np.ndarray, boundary: int) -> tuple[np.ndarray, np.ndarray]:
        """What kind says of each training token and of the token before it."""
        seq = kind[self.codes]
        before = np.r_[seq[:1], seq[:-1]]
        before[self.starts] = boundary
        return before[self.learned], seq[self.learned]


def _f(x):
    return x * np.log(np.maximum(x, 1.0))


def _likelihood(c: np.ndarray) -> float:
    return float(_f(c).sum() - _f(c.sum(axis=0)).sum() - _f(c.sum(axis=1)).sum())


def _thin(x: np.ndarray) -> bytes:
    """32-bit numbers byte by byte, so that the empty ones lie together and compress."""
    return x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _thick(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64)


def _merged(keys: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[new], np.add.reduceat(n, new) if len(new) else n


def exchange(key: np.ndarray, n: np.ndarray, of: np.ndarray, c: np.ndarray) -> np.ndarray:
    """New classes of some items, the most frequent first, by their neighbours' classes.

    of has the items' classes and c the class bigrams of the corpus, of which
    these items are part. key is item * (2 * classes + 1) + slot, in order: the
    class after the item, classes + the class before it, or 2 * classes where
    the item follows itself. Class 0 takes no item.
    """
    classes = len(c)
    slots = 2 * classes + 1
    of, c = of.copy(), c.astype(np.float64)
    left, right, logs = c.sum(axis=1), c.sum(axis=0), _f(c)
    item, slot = key // slots, key % slots
    start = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
    stop = np.r_[start[1:], len(item)]
    weight = np.add.reduceat(n, start)

    def put(k, sign):
        c[k, after] += sign * n_after
        c[before, k] += sign * n_before
        c[k, k] += sign * own
        left[k] += sign * out
        right[k] += sign * into
        logs[k, after], logs[before, k], logs[k, k] = _f(c[k, after]), _f(c[before, k]), _f(c[k, k])

    for g in np.argsort(-weight, kind="stable").tolist():
        a, z = start[g], stop[g]
        i, s, m = item[a], slot[a:z], n[a:z].astype(np.float64)
        x, y = np.searchsorted(s, (classes, 2 * classes))
        after, n_after, before, n_before, own = s[:x], m[:x], s[x:y] - classes, m[x:y], m[y:].sum()
        out, into = n_after.sum() + own, n_before.sum() + own
        k = of[i]
        put(k, -1)
        # Gain of joining class j: row j, column j and their margins change.
        gain = (_f(c[:, after] + n_after) - logs[:, after]).sum(axis=1) + (_f(c[before] + n_before[:, None]) - logs[before]).sum(axis=0)
        row, col = np.zeros(classes), np.zeros(classes)
        row[after], col[before] = n_after, n_before
        d = np.diagonal(c)
        gain += _f(d + row + col + own) - _f(d + row) - _f(d + col) + np.diagonal(logs)
        gain -= _f(left + out) - _f(left) + _f(right + into) - _f(right)
        gain[0] = -np.inf
        j = int(np.argmax(gain))
        of[i] = k = j if gain[j] > gain[k] + 1e-9 else k
        put(k, 1)
    return of


def cluster(pairs: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Classes of items by exchange: each item in turn goes where the likelihood of class bigrams is largest.

    pairs[a, b] counts item b after item a. The boundary, the last item, keeps
    class 0 to itself. Rounds end early when no item moves.
    """
    n = len(pairs)
    total = pairs.sum(axis=0) + pairs.sum(axis=1)
    order = np.argsort(-total[:-1], kind="stable")
    of = np.zeros(n, np.int64)
    of[order] = 1 + np.arange(n - 1) % (classes - 1)
    one = np.zeros((n, classes))
    one[np.arange(n), of] = 1
    c = one.T @ pairs @ one
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    to = pairs @ one  # to[a, k]: counts of class k after item a
    back = pairs.T @ one  # back[b, k]: counts of class k before item b
    for _ in range(rounds):
        moved = 0
        for i in order:
            if not total[i]:
                continue
            k, own = of[i], pairs[i, i]
            row, col = to[i].copy(), back[i].copy()
            row[k] -= own
            col[k] -= own
            c[k] -= row
            c[:, k] -= col
            c[k, k] -= own
            left, right = c.sum(axis=1), c.sum(axis=0)
            # Gain of joining class j: only row j, column j and the two margins change.
            gain = (f(c + row) - f(c)).sum(axis=1) + (f(c + col[:, None]) - f(c)).sum(axis=0)
            d = np.diagonal(c)
            gain += f(d + row + col + own) - f(d + row) - f(d + col) + f(d)
            out, into = row.sum() + own, col.sum() + own
            gain -= f(left + out) - f(left) + f(right + into) - f(right)
            gain[0] = -np.inf
            j = int(np.argmax(gain))
            if gain[j] <= gain[k] + 1e-9:
                j = k
            c[j] += row
            c[:, j] += col
            c[j, j] += own
            if j != k:
                moved += 1
                of[i] = j
                to[:, k] -= pairs[:, i]
                to[:, j] += pairs[:, i]
                back[:, k] -= pairs[i]
                back[:, j] += pairs[i]
        if not moved:
            break
    return of


def tables(of: np.ndarray, c: np.ndarray, n_item: np.ndarray, kinds_item: np.ndarray, tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of the class transitions, and of the room that a class's words share; of: items' classes, c: class bigrams."""
    classes = len(c)
    n_class, kinds_class = np.bincount(of, n_item, classes), np.bincount(of, kinds_item, classes)
    unigram = (n_class + 1) / (tokens + classes)
    log_trans = np.log10((c + BACKOFF * unigram) / (c.sum(axis=1, keepdims=True) + BACKOFF))
    log_room = np.log10(n_class + kinds_class + 1)  # one more kind for words never seen
    log_room[0] = np.log10(max(n_class[0] + 1, 1.0))  # class 0 holds the end token alone
    return log_trans, log_room


def score(docs: DataFrame, held: int = 2, modulus: int = 7) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every row of docs.

    The model and all counts come from the rows whose crc32(doc_id) modulo
    modulus is not held. Null texts count as empty: one end token. Null ids are
    learned from. With nothing to learn from, all words are unknown. score is
    the log10 probability of the text, perplexity 10 ** (-score / n_tokens).
    """
    spark = docs.sparkSession
    tune(spark, 250, 4)
    out = remainder(F.col("doc_id"), modulus) == held
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), out.alias("held"), F.coalesce("text", F.lit("")).alias("text"))
    buckets = max(64, input_bytes(docs) >> 21)
    coded = materialize(rows.mapInArrow(_coder(buckets), _CODED_DDL))
    blocks = coded.where("codes IS NOT NULL").select("block", "end", "tails", "doc_id", "size", "held", "codes")
    entries = coded.where("bucket IS NOT NULL").select("bucket", "block", "words", "at", "n")
    # A word is in a block's dictionary once, so no bucket has more rows than there are blocks.
    answers = materialize(entries.groupBy("bucket").applyInArrow(_add_up, _ANSWER_DDL))

    # A count and an ending for each item, the buckets' items one after another.
    listed = answers.where("items IS NOT NULL").select("bucket", "items", "tails", "end").orderBy("bucket").toArrow().to_pylist()
    n_own = np.frombuffer(b"".join(r["items"] for r in listed), np.int64)
    tail_own = np.frombuffer(b"".join(r["tails"] for r in listed), np.uint16).astype(np.int64)
    n_end = sum(r["end"] for r in listed)
    offset = np.zeros(buckets, np.int64)
    for r, at in zip(listed, np.cumsum([0, *(len(r["items"]) // 8 for r in listed)]).tolist()):
        offset[r["bucket"]] = at
    n_tails, classes = sizes(len(n_own))
    boundary = len(n_own) + n_tails
    n_item, kinds_item = np.zeros(boundary + 1), np.zeros(boundary + 1)
    n_item[: len(n_own)], kinds_item[: len(n_own)] = n_own, 1
    for r in answers.where("tail IS NOT NULL").groupBy("tail").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds")).collect():  # 65536 rows at most
        n_item[len(n_own) + r["tail"] % n_tails] += r["n"]
        kinds_item[len(n_own) + r["tail"] % n_tails] += r["kinds"]
    n_item[boundary], kinds_item[boundary] = n_end, n_end > 0
    tokens, kinds = int(n_item.sum()), int(kinds_item.sum())

    # The first items: top words, then endings of all others.
    first = np.r_[TOP + tail_own % TAILS, TOP + np.arange(n_tails) % TAILS, BOUNDARY]
    top = np.argsort(-n_own, kind="stable")[:TOP]
    first[top] = np.arange(len(top))
    numbered = spark.sparkContext.broadcast((offset, first.astype(np.int16)))
    n_words = len(n_own)

    def answered(key, block, found):
        offset, first = numbered.value
        row = block.to_pylist()[0]
        x = np.frombuffer(row["codes"], np.uint16 if len(row["codes"]) == 2 * np.frombuffer(row["size"], np.int64).sum() else np.uint32)
        item = n_words + np.frombuffer(row["tails"], np.uint16).astype(np.int32) % np.int32(n_tails)
        item[row["end"]] = boundary
        c = np.bincount(x[np.repeat(np.frombuffer(row["held"], np.uint8) & 1 == 0, np.frombuffer(row["size"], np.int64))], minlength=len(item))
        for r in found.to_pylist():
            at, own = np.frombuffer(r["at"], np.int32), np.frombuffer(r["own"], np.int32)
            c[at] = np.frombuffer(r["c"], np.int64)
            item[at[own >= 0]] = own[own >= 0] + offset[r["bucket"]]
        row |= {"item": item.astype(np.int32).tobytes(), "first": first[item].tobytes(), "c": c.astype(np.int64).tobytes()}
        return pa.Table.from_pylist([{k: row[k] for k in _READ.names}], _READ)

    mine = answers.where("block IS NOT NULL").select("bucket", "block", "at", "c", "own")
    read = materialize(blocks.groupBy("block").cogroup(mine.groupBy("block")).applyInArrow(answered, _READ_DDL))

    def bigrams(kind, boundary, size):
        """Dense counts of what kind says of tokens and the tokens before them, size ** 2 at most."""

        def run(batches):
            total = np.zeros(size * size, np.int64)
            for batch in batches:
                for row in batch.to_pylist():
                    x = _Coded(row)
                    before, seq = x.pairs(kind(x), boundary)
                    total += np.bincount(before.astype(np.int64) * size + seq, minlength=len(total))
            pair = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int32()), pa.array(total[pair])], names=["pair", "n"])

        out = np.zeros(size * size)
        table = read.mapInArrow(run, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
        out[table.column("pair").to_numpy()] = table.column("n").to_numpy()
        return out.reshape(size, size)

    of = cluster(bigrams(lambda x: x.first, BOUNDARY, FIRST), classes)[first]
    windows, slots = max(64, buckets // 4), 2 * classes + 1
    wide = (boundary // windows + 1) * slots  # keys of a window

    def class_bigrams(of):
        shared = spark.sparkContext.broadcast(of.astype(np.int16))
        return shared, bigrams(lambda x: shared.value[x.item], 0, classes)

    def neighbours(shared):
        def run(batches):
            keys, counts, load = [], [], 0

            def flush():
                key, n = _merged(keys, counts)
                cut = np.searchsorted(key, np.arange(windows + 1) * wide)
                some = np.flatnonzero(np.diff(cut)).tolist()
                part = [slice(cut[w], cut[w + 1]) for w in some]
                return pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array([_thin(np.diff(key[p] - w * wide, prepend=0)) for w, p in zip(some, part)], pa.binary()), pa.array([_thin(n[p]) for p in part], pa.binary())],
                    names=["window", "key", "n"],
                )

            for batch in batches:
                for row in batch.to_pylist():
                    x = _Coded(row)
                    before, seq = (t.astype(np.int64) for t in x.pairs(x.item, boundary))
                    same = before == seq
                    place = lambda t: t % windows * wide + t // windows * slots
                    ahead, back, own = (before != boundary) & ~same, (seq != boundary) & ~same, same & (seq != boundary)
                    key = np.r_[place(before[ahead]) + shared.value[seq[ahead]], place(seq[back]) + classes + shared.value[before[back]], place(seq[own]) + 2 * classes]
                    key, n = np.unique(key, return_counts=True)
                    keys.append(key), counts.append(n)
                    load += len(key)
                    if load > MERGE:
                        yield flush()
                        keys, counts, load = [], [], 0
            if load:
                yield flush()

        return read.mapInArrow(run, "window int, key binary, n binary")

    def exchanged(shared, c):
        def run(rows: pa.Table) -> pa.Table:
            w = rows.column("window")[0].as_py()
            key, n = _merged([np.cumsum(_thick(k)) for k in rows.column("key").to_pylist()], [_thick(k) for k in rows.column("n").to_pylist()])
            # Items of a window are every windows-th one.
            of = exchange(key, n, shared.value[w::windows].astype(np.int64), c.value)
            return pa.table({"window": pa.array([w], pa.int32()), "classes": pa.array([of.astype(np.int16).tobytes()], pa.binary())})

        found = neighbours(shared).groupBy("window").applyInArrow(run, "window int, classes binary").toArrow()  # a class for each item
        return dict(zip(found.column("window").to_pylist(), found.column("classes").to_pylist()))

    shared, c2 = class_bigrams(of)
    for _ in range(EXCHANGES):
        new = of.copy()
        for w, found in exchanged(shared, spark.sparkContext.broadcast(c2)).items():
            new[w::windows] = np.frombuffer(found, np.int16)
        moved, c3 = class_bigrams(new)
        if _likelihood(c3) <= _likelihood(c2):  # windows do not see each other's moves
            break
        of, shared, c2 = new, moved, c3

    log_trans, log_room = tables(of, c2, n_item, kinds_item, tokens)
    model = spark.sparkContext.broadcast((log_trans, log_room))
    log_base = np.log10(tokens + kinds + 1.0)

    def scored(batches):
        log_trans, log_room = model.value
        for batch in batches:
            for row in batch.to_pylist():
                x = _Coded(row)
                of = shared.value[x.item]
                k = of[x.codes]
                before = np.r_[k[:1], k[:-1]]
                before[x.starts] = 0
                emit = np.log10(x.c + 1.0) - log_room[of]
                base = np.log10(x.c + 1.0) - log_base
                total = np.add.reduceat(log_trans[before, k] + emit[x.codes], x.starts)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(x.ids, pa.int64(), mask=x.no_id),
                    "held_out": x.held, "n_tokens": x.size, "n_known": np.add.reduceat((x.c > 0)[x.codes].astype(np.int64), x.starts),
                    "train_tokens": np.full(len(x.size), tokens, np.int64), "base_score": np.add.reduceat(base[x.codes], x.starts),
                    "score": total, "perplexity": 10.0 ** np.minimum(-total / x.size, 300.0),
                })

    return read.mapInArrow(
        scored, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double"
    )
