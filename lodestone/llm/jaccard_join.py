"""N-gram Jaccard join with vertical partitioning.

Texts are sets of word shingles. Pass one cuts the space of shingle hashes into
fragments; each fragment counts in how many texts its shingles are and answers
each text with those that are not alone. A text that has too few of these can
have no partner. For the others, shingles are put in one global order, rare
first, and texts that share one in their prefixes become candidates. Groups of
candidates are dealt to tiles of two blocks; a text goes to the tiles of those
blocks that hold a candidate of it, so that a chain of candidates costs as its
length does. The order by hash is cut into fragments again: every fragment of a
tile counts the partial overlaps of all its pairs at once, and the sums per pair
decide which pairs link. Pairs are never rows: a tile's answer is its link counts
and a forest of its links.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textops
from lodestone.llm.graph import components, forest
from lodestone.llm.runtime import fresh_name, input_bytes, materialize, tune

NUM, DEN = 3, 4  # texts link from this similarity on
BLOCK = 128  # texts in a block of a group, about
CUTS = 8  # fragments that a tile's shingles are cut into
_HASH = np.uint64((1 << 48) - 1)


def needed(n: np.ndarray) -> np.ndarray:
    """Least overlap that a set of n has with any partner."""
    return -(-NUM * n // DEN)


# ---- pass one: document frequencies by fragment of the hash space

_SENT = pa.schema([("fragment", pa.int32()), ("batch", pa.int64()), ("n", pa.binary()), ("low", pa.binary()), ("high", pa.binary()), ("doc_id", pa.binary()), ("text_id", pa.binary()), ("print", pa.binary())])
_SENT_DDL = "fragment int, batch bigint, n binary, low binary, high binary, doc_id binary, text_id binary, print binary"
_LAST = int(np.iinfo(np.int64).max)
SEND_BYTES, SEND_TEXTS = 8 << 20, 60_000  # texts that are sent as one batch, about; numbers of texts have 16 bits


def _gathered(batches):
    """Batches put together until they have SEND_BYTES or SEND_TEXTS."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for a in range(0, batch.num_rows, SEND_TEXTS):
            part = batch.slice(a, SEND_TEXTS)
            if held and (sum(x.num_rows for x in held) + part.num_rows > SEND_TEXTS or sum(x.nbytes for x in held) + part.nbytes > SEND_BYTES):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _steps(numbers: np.ndarray) -> bytes:
    """Ascending numbers as the steps between them: a byte each where none is larger, else two."""
    steps = np.diff(numbers, prepend=np.uint16(0))
    return steps.astype(np.uint8 if len(steps) and steps.max() < 256 else np.uint16).tobytes()


def _numbers(raw: bytes, n: int) -> np.ndarray:
    """The inverse of _steps, for n numbers."""
    return np.cumsum(np.frombuffer(raw, np.uint8 if len(raw) == n else np.uint16), dtype=np.uint16)


def _sender(fragments: int):
    """Per batch of texts one row with their ids, sizes and prints, and one for each fragment's shingles, each with the number of its text."""
    width = np.uint64(48 - (fragments.bit_length() - 1))

    def send(batches):
        part, number = TaskContext.get().partitionId(), 0
        for batch in _gathered(batches):
            sets = textops.shingles(*textops.word_hashes(*textops.utf8(batch.column(2))))
            sets = [np.unique(s & _HASH) for s in sets]
            name = (part << 32) + number
            number += 1
            known = batch.column(0).is_valid().to_numpy().astype(np.uint8)
            ids = batch.column(0).fill_null(0).to_numpy()
            size = np.array([len(s) for s in sets], np.int32)
            prints = b"".join(hashlib.blake2b(s.data, digest_size=16).digest() for s in sets)
            yield pa.RecordBatch.from_pylist([{"fragment": -1, "batch": name, "n": size.tobytes(), "low": known.tobytes(), "doc_id": ids.tobytes(), "text_id": batch.column(1).to_numpy().tobytes(), "print": prints}], _SENT)
            every = np.concatenate(sets)
            fragment = (every >> width).astype(np.uint32)
            order = np.argsort(fragment, kind="stable")
            doc = np.repeat(np.arange(len(sets), dtype=np.uint16), size)[order]
            every, fragment = every[order], fragment[order]
            cut = np.searchsorted(fragment, np.arange(fragments + 1))
            there = np.flatnonzero(np.diff(cut))
            for a in range(0, len(there), 1024):
                rows = []
                for i in there[a : a + 1024].tolist():
                    h = every[cut[i] : cut[i + 1]] & np.uint64((1 << int(width)) - 1)
                    rows.append({"fragment": i, "batch": name, "n": _steps(doc[cut[i] : cut[i + 1]]), "low": h.astype(np.uint32).tobytes(), "high": (h >> np.uint64(32)).astype(np.uint16).tobytes()})
                yield pa.RecordBatch.from_pylist(rows, _SENT)

    return send


def _frequencies(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """One fragment: each batch's shingles that another text has too, with their frequency, at most 255."""
    fragment, parts = key[0].as_py(), rows.to_pylist()
    if fragment < 0:
        return rows.cast(_SENT)
    hashes = [np.frombuffer(r["low"], np.uint32).astype(np.uint64) | np.frombuffer(r["high"], np.uint16).astype(np.uint64) << np.uint64(32) for r in parts]
    every, which, count = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    count = np.minimum(count, 255)[which].astype(np.uint8)
    out, at = [], 0
    for r, h in zip(parts, hashes):
        df = count[at : at + len(h)]
        at += len(h)
        keep = df > 1
        if keep.any():
            out.append({"fragment": fragment, "batch": r["batch"], "n": _steps(_numbers(r["n"], len(h))[keep]), "low": h[keep].astype(np.uint32).tobytes(), "high": (h[keep] >> np.uint64(32)).astype(np.uint16).tobytes(), "doc_id": None, "text_id": None, "print": df[keep].tobytes()})
    return pa.Table.from_pylist(out, _SENT)


_TEXT_DDL = "doc_id bigint, text_id bigint, n bigint, print binary, shared binary"


def _gatherer(fragments: int):
    """One batch: its texts again, each with its shared shingles in the global order if they can suffice."""
    width = np.uint64(48 - (fragments.bit_length() - 1))

    def gather(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        parts = rows.to_pylist()
        head = next(r for r in parts if r["fragment"] < 0)
        ids, size = np.frombuffer(head["doc_id"], np.int64), np.frombuffer(head["n"], np.int32).astype(np.int64)
        prints = [head["print"][i : i + 16] for i in range(0, len(head["print"]), 16)]
        docs, places = [np.zeros(0, np.uint16)], [np.zeros(0, np.uint64)]
        for r in parts:
            if r["fragment"] >= 0:
                h = np.frombuffer(r["low"], np.uint32).astype(np.uint64) | np.frombuffer(r["high"], np.uint16).astype(np.uint64) << np.uint64(32)
                df = np.frombuffer(r["print"], np.uint8).astype(np.uint64)
                places.append(df << np.uint64(48) | np.uint64(r["fragment"]) << width | h)
                docs.append(_numbers(r["n"], len(h)))
        doc, place = np.concatenate(docs), np.concatenate(places)
        order = np.lexsort((place, doc))
        place = place[order]
        have = np.bincount(doc, minlength=len(ids))
        cut = np.r_[0, np.cumsum(have)]
        enough = (have >= needed(size)) & (size > 0)
        shared = [place[cut[i] : cut[i + 1]].tobytes() if enough[i] else None for i in range(len(ids))]
        return pa.table({
            "doc_id": pa.array(ids, pa.int64(), mask=np.frombuffer(head["low"], np.uint8) == 0), "text_id": np.frombuffer(head["text_id"], np.int64), "n": size,
            "print": pa.array(prints, pa.binary()), "shared": pa.array(shared, pa.binary()),
        })

    return gather


def _prefixes(batches):
    """The rare shared shingles of each text of which any partner must have one."""
    for batch in batches:
        doc, place = [], []
        for d, n, shared in zip(*(batch.column(i).to_pylist() for i in range(3))):
            s = np.frombuffer(shared, np.int64)
            k = len(s) - int(needed(np.int64(n))) + 1
            doc.append(np.full(k, d)), place.append(s[:k])
        none = np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(place or [none])), pa.array(np.concatenate(doc or [none]))], names=["place", "node"])


# ---- tiles


def _cut_up(batches):
    """Per text and fragment of the order, its shingles; texts without any in a fragment have no row there."""
    for batch in batches:
        rows = []
        for g, b, others, d, n, w, shared in zip(*(batch.column(i).to_pylist() for i in range(7))):
            s = np.frombuffer(shared, np.uint64)
            fragment = ((s & _HASH) // np.uint64((1 << 48) // CUTS)).astype(np.int64)
            for c in range(CUTS):
                mine = s[fragment == c]
                if len(mine) or not c:
                    rows.append({"g": g, "b": b, "others": others, "cut": c, "node": d, "n": n, "w": w, "shared": mine.tobytes()})
        yield pa.RecordBatch.from_pylist(rows, _CUT)


_CUT = pa.schema([("g", pa.int64()), ("b", pa.int32()), ("cut", pa.int32()), ("others", pa.list_(pa.int32())), ("node", pa.int64()), ("n", pa.int64()), ("w", pa.int64()), ("shared", pa.binary())])
_CUT_DDL = "g bigint, b int, cut int, others array<int>, node bigint, n bigint, w bigint, shared binary"


def _stream(batches, key_columns: int):
    """Consecutive rows of one key, over batch borders."""
    held, key = [], None
    for batch in batches:
        for row in batch.to_pylist():
            k = tuple(row.values())[:key_columns]
            if k != key and held:
                yield key, held
                held = []
            key = k
            held.append(row)
    if held:
        yield key, held


def _blocks(batches):
    """Blocks of texts: to every tile that they are part of, those that have candidates there."""
    rows = []
    for (g, b, cut), texts in _stream(batches, 3):
        texts.sort(key=lambda r: r["node"])
        tiles: dict[int, list] = {}
        for r in texts:
            for other in r["others"]:
                tiles.setdefault(other, []).append(r)
        whole = None
        for other, some in tiles.items():
            body = whole if len(some) == len(texts) else None
            if body is None:
                body = {
                    "node": np.array([r["node"] for r in some], np.int64).tobytes(), "n": np.array([r["n"] for r in some], np.int64).tobytes(),
                    "w": np.array([r["w"] for r in some], np.int64).tobytes(), "size": np.array([len(r["shared"]) // 8 for r in some], np.int64).tobytes(),
                    "shared": b"".join(r["shared"] for r in some),
                }
                whole = body if len(some) == len(texts) else whole
            rows.append({"g": g, "i": min(b, other), "j": max(b, other), "cut": cut, "b": b} | body)
            if len(rows) >= 64:
                yield pa.RecordBatch.from_pylist(rows, _SIDE)
                rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _SIDE)


_SIDE = pa.schema([("g", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("cut", pa.int32()), ("b", pa.int32()), *((k, pa.binary()) for k in ("node", "n", "w", "size", "shared"))])
_SIDE_DDL = "g bigint, i int, j int, cut int, b int, node binary, n binary, w binary, size binary, shared binary"


def overlaps(a: np.ndarray, size_a: np.ndarray, b: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """How many shingles each set of a shares with each of b; sets end to end, with their sizes."""
    both = np.intersect1d(a, b)
    out = np.zeros((len(size_a), len(size_b)), np.float32)
    row_a, row_b = np.repeat(np.arange(len(size_a)), size_a), np.repeat(np.arange(len(size_b)), size_b)
    for x in range(0, len(both), 4096):
        part = both[x : x + 4096]
        sides = []
        for s, row, n in ((a, row_a, len(size_a)), (b, row_b, len(size_b))):
            at = np.minimum(np.searchsorted(part, s), len(part) - 1)
            hit = part[at] == s
            side = np.zeros((n, len(part)), np.float32)
            side[row[hit], at[hit]] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out


def _partial(batches):
    """One fragment of one tile: ids and partial overlaps of its pairs that have any."""
    for (g, i, j, cut), sides in _stream(batches, 4):
        read = lambda r, k, t=np.int64: np.frombuffer(r[k], t)
        one = next((r for r in sides if r["b"] == i), None)
        two = next((r for r in sides if r["b"] == j), None)
        row = {"g": g, "i": i, "j": j, "cut": cut, "a": None, "b": None, "x": None, "y": None, "c": None}
        if one is not None and two is not None:
            c = overlaps(read(one, "shared", np.uint64), read(one, "size"), read(two, "shared", np.uint64), read(two, "size"))
            x, y = np.nonzero(c)
            row |= {"x": x.astype(np.uint16).tobytes(), "y": y.astype(np.uint16).tobytes(), "c": c[x, y].astype(np.uint32).tobytes()}
            for k, r in (("a", one), ("b", two)):
                row[k] = np.stack([read(r, "node"), read(r, "n"), read(r, "w")]).tobytes()
            yield pa.RecordBatch.from_pylist([row], _PART)


_PART = pa.schema([("g", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("cut", pa.int32()), *((k, pa.binary()) for k in "abxyc")])
_PART_DDL = "g bigint, i int, j int, cut int, a binary, b binary, x binary, y binary, c binary"


def _sum_up(batches):
    """One tile: partial overlaps summed per pair; links counted per text, and a forest of them."""
    for (_, i, j), parts in _stream(batches, 3):
        sides = []
        for k in "ab":
            known = np.concatenate([np.frombuffer(r[k], np.int64).reshape(3, -1) for r in parts], axis=1)
            _, first = np.unique(known[0], return_index=True)
            sides.append(known[:, first])
        (ids_a, n_a, w_a), (ids_b, n_b, w_b) = sides
        total = np.zeros((len(ids_a), len(ids_b)), np.int64)
        for r in parts:
            mine_a, mine_b = (np.frombuffer(r[k], np.int64).reshape(3, -1)[0] for k in "ab")
            x, y = (np.frombuffer(r[k], np.uint16) for k in "xy")
            total[np.searchsorted(ids_a, mine_a)[x], np.searchsorted(ids_b, mine_b)[y]] += np.frombuffer(r["c"], np.uint32)
        link = DEN * total >= NUM * (n_a[:, None] + n_b[None, :] - total)
        link &= total > 0
        if i == j:
            np.fill_diagonal(link, False)
        x, y = np.nonzero(link)
        a, b = forest(ids_a[x], ids_b[y])
        links = {}
        for ids, count in ((ids_a, link @ w_b), *(((ids_b, link.T @ w_a),) if i != j else ())):
            for d, n in zip(ids.tolist(), count.tolist()):
                if n:
                    links[d] = links.get(d, 0) + n
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[a, list(links)].astype(np.int64)), pa.array(np.r_[b, np.zeros(len(links), np.int64)].astype(np.int64)), pa.array(np.r_[np.zeros(len(a), np.int64), list(links.values())].astype(np.int64))],
            names=["a", "b", "links"],
        )


def _partners(prefix: DataFrame, blocked: DataFrame) -> DataFrame:
    """node and others: the blocks of its group in which it may have candidates.

    A place stands for the set of blocks that its texts are in; a large group has
    few different sets, so that they, not the pairs, are what is listed.
    """
    held = prefix.join(blocked.where("blocks > 1").select("node", "b"), "node")
    sets = held.groupBy("place").agg(F.array_sort(F.collect_set("b")).alias("s"))
    listed = held.join(sets, "place").select("node", "s").distinct().select("node", F.explode("s").alias("b"))
    return listed.groupBy("node").agg(F.array_sort(F.collect_set("b")).alias("others"))


def _linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows as doc_id, text_id, n and print; and of each print the component, its least doc_id, and the links of one row."""
    spark = docs.sparkSession
    tune(spark)
    text = F.coalesce("text", F.lit(""))
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_id"), text.alias("text"))
    fragments = 1 << max(6, (input_bytes(docs) >> 21).bit_length())
    sent = plain.mapInArrow(_sender(fragments), _SENT_DDL)
    # Texts' ids skip the fragments: they only wait for their batch's answers.
    spread = F.when(F.col("fragment") < 0, -1 - F.pmod(F.xxhash64("batch"), F.lit(fragments))).otherwise(F.col("fragment"))
    answered = sent.withColumn("fragment", spread.cast("int")).groupBy("fragment").applyInArrow(_frequencies, _SENT_DDL)
    texts = materialize(answered.groupBy("batch").applyInArrow(_gatherer(fragments), _TEXT_DDL))

    # Equal sets are one node and weigh as many as they are. The table is written, so that the numbers stay.
    same = texts.where("n > 0").groupBy("print").agg(F.min("doc_id").alias("least"), F.count("*").alias("w"), F.first("n").alias("n"), F.first("shared").alias("shared"))
    nodes = materialize(same.withColumn("node", F.monotonically_increasing_id()))
    whole = nodes.where("shared IS NOT NULL").select("node", "n", "w", "shared")

    prefix = materialize(whole.select("node", "n", "shared").mapInArrow(_prefixes, "place bigint, node bigint"))
    least = prefix.groupBy("place").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z")
    groups = components(prefix.join(least, "place").select("a", F.col("node").alias("b"))).withColumnRenamed("component", "g")
    sizes = groups.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    blocked = materialize(groups.join(sizes, "g").withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))

    dealt = whole.join(blocked, "node").join(_partners(prefix, blocked), "node", "left")
    cut = dealt.select("g", "b", F.coalesce("others", F.array("b")).alias("others"), "node", "n", "w", "shared").mapInArrow(_cut_up, _CUT_DDL)
    parts = max(spark.sparkContext.defaultParallelism * 2, int(spark.conf.get("spark.sql.shuffle.partitions")), input_bytes(docs) >> 23)
    sides = cut.repartition(parts, "g", "b", "cut").sortWithinPartitions("g", "b", "cut").mapInArrow(_blocks, _SIDE_DDL)
    partial = sides.repartition(parts, "g", "i", "j", "cut").sortWithinPartitions("g", "i", "j", "cut").mapInArrow(_partial, _PART_DDL)
    tiles = partial.repartition(parts, "g", "i", "j").sortWithinPartitions("g", "i", "j")
    found = materialize(tiles.mapInArrow(_sum_up, "a bigint, b bigint, links bigint"))

    linked = components(found.where("links = 0").select("a", "b"))
    of = nodes.select("node", "print", "least", "w")
    first = linked.join(of, "node").groupBy("component").agg(F.min("least").alias("cid"))
    counts = found.where("links > 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    named = of.join(linked.join(first, "component"), "node", "left").join(counts, "node", "left")
    own = F.col("component").isNull()
    named = named.select(
        F.col("print").alias("p2"), F.when(own, F.col("node")).otherwise(F.col("component")).alias("c"), F.when(own, F.col("least")).otherwise(F.col("cid")).alias("cid"),
        (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("links"),
    )
    return texts.select("doc_id", "text_id", "n", "print"), named


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of every row of docs.

    Two texts link when the Jaccard similarity of their sets of five-word
    shingles is at least NUM / DEN. component_id is the least doc_id reachable
    by links, n_links how many other rows a text links with, equal sets
    included. Texts without words, null ones too, are linked with nothing; rows
    with a null doc_id count for others' links and have a null component_id.
    Rows that repeat a doc_id are rows of their own, each by its text.
    """
    rows, named = _linked(docs)
    out = rows.join(named, (F.col("print") == F.col("p2")) & (F.col("n") > 0), "left")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("cid", "doc_id")).alias("component_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The first row of each component, with all its columns: that of the least doc_id, null ones last, and of the least text hash on ties.

    Of rows that are equal in doc_id and text one stays. Texts without words are
    in no component and all stay.
    """
    rows, named = _linked(docs)
    doc = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST))
    best = rows.where("n > 0").join(named, F.col("print") == F.col("p2")).groupBy("c").agg(F.min(F.struct(doc.alias("d"), F.col("text_id").alias("t"))).alias("first"))
    d, t, one = (fresh_name(docs, c) for c in ("d", "t", "one"))
    keys = best.select(F.col("first.d").alias(d), F.col("first.t").alias(t), F.lit(True).alias(one))
    keys = keys.unionAll(rows.where("n = 0").select(doc, "text_id", F.lit(False)).distinct())
    kept = docs.select("*", doc.alias(d), F.xxhash64(F.coalesce("text", F.lit(""))).alias(t)).join(keys, [d, t])
    once = kept.where(F.col(one)).dropDuplicates([d, t]).unionAll(kept.where(~F.col(one)))
    return once.select(*(F.col(f"`{c}`") for c in docs.columns))
