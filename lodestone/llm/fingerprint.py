"""Document fingerprints by one-permutation MinHash with optimal densification.

The shingle hashes of a text are dealt once into bins by their top bits and each
bin keeps its least value. An empty bin copies a non-empty one, found by a hash
of the bin's number and the attempt, the same for all texts. The low-order bits
of every bin are packed; likeness is the share of equal bins, corrected for
bins that agree by chance.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm import textops
from lodestone.llm.runtime import input_bytes, materialize, tune

BINS = 512  # a power of two
BITS = 4  # 1, 2 or 4; 255 marks a text without words
_ROUNDS = 1 << 14
_FAN = 64


def _donors(attempt: int) -> np.ndarray:
    """The bin that each bin turns to at this attempt."""
    at = np.arange(BINS, dtype=np.uint64) + np.uint64(attempt) * np.uint64(BINS) + np.uint64(1)
    return (textops.mix(at * np.uint64(0xD1342543DE82EF95)) >> np.uint64(65 - BINS.bit_length())).astype(np.int64)


def signatures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bins of all texts, BITS low-order bits each; a text without words has the row of all 255."""
    hashes, doc = textops.shingle_rows(*textops.word_hashes(data, offsets))
    n = len(offsets) - 1
    top = np.uint64(65 - BINS.bit_length())
    least = np.full(n * BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, doc * BINS + (hashes >> top).astype(np.int64), textops.mix(hashes))
    least = least.reshape(n, BINS)
    full = least != np.iinfo(np.uint64).max
    row, col = np.nonzero(~full & full.any(axis=1)[:, None])
    for attempt in range(_ROUNDS):
        if not len(row):
            break
        donor = _donors(attempt)[col]
        found = full[row, donor]
        least[row[found], col[found]] = least[row[found], donor[found]]
        row, col = row[~found], col[~found]
    for r, c in zip(row.tolist(), col.tolist()):  # almost never: take the next full bin
        least[r, c] = least[r, (c + int(np.argmax(np.roll(full[r], -c)))) % BINS]
    # The bits also depend on the bin, so that one value in many bins does not agree by chance in all of them at once.
    bits = textops.mix(least + np.arange(BINS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = (bits & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    out[~full.any(axis=1)] = 255
    return out


def pack(row: np.ndarray) -> str:
    """Hexadecimal form of one text's bins; empty for a text without words."""
    if row[0] == 255:
        return ""
    bits = np.unpackbits(row[:, None], axis=1)[:, 8 - BITS :]
    return np.packbits(bits).tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of rows of bins, 0 to 1; two texts without words are alike."""
    chance = 0.5**BITS
    found = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0.0, 1.0)
    none = (a[:, 0] == 255).astype(int) + (b[:, 0] == 255)
    return np.where(none == 2, 1.0, np.where(none == 1, 0.0, found))


def _bins_of(texts: list[str]) -> np.ndarray:
    return signatures(*textops.utf8(pa.array(texts, pa.large_string())))


_OUT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_EDGES = "part int, edge string, text string"


def _fingerprints(batches):
    """Answers to all rows (doc_id, text) of a range but the last, and its first and last row."""
    part, first, held = TaskContext.get().partitionId(), None, []
    for batch in batches:
        rows = held + list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        first = first or rows[:1]
        held = rows[-1:]
        if len(rows) > 1:
            found = _compare(rows)
            yield pa.RecordBatch.from_arrays([*found.columns, *(pa.nulls(found.num_rows, kind) for kind in (pa.int32(), pa.string(), pa.string()))], names=[*found.schema.names, "part", "edge", "text"])
    edges = [*(("first", *r) for r in first or ()), *(("last", *r) for r in held)]
    if edges:
        none = [pa.nulls(len(edges), kind) for kind in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
        own = [pa.array([e[1] for e in edges], pa.int64()), *none, pa.array([part] * len(edges), pa.int32()), pa.array([e[0] for e in edges]), pa.array([e[2] for e in edges], pa.string())]
        yield pa.RecordBatch.from_arrays(own, names=[c.split()[0] for c in f"{_OUT}, {_EDGES}".split(", ")])


def _compare_edges(batches):
    """Answers to rows (doc_id, text, next)."""
    for batch in batches:
        for doc_id, text, after in zip(*(c.to_pylist() for c in batch.columns)):
            yield _compare([(doc_id, text), (None, after)])


def _compare(rows: list[tuple]) -> pa.RecordBatch:
    """rows: doc_id, text in order; all but the last are answered."""
    text = [r[1] or "" for r in rows]
    edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in itertools.pairwise(text)]
    bins, changed = _bins_of(text), _bins_of(edited)
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array([r[0] for r in rows[:-1]], pa.int64()),
        "n_chars": pa.array([len(t) for t in text[:-1]], pa.int64()),
        "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
        "fingerprint": [pack(r) for r in bins[:-1]],
        "edited_fingerprint": [pack(r) for r in changed],
        "near_edited": likeness(bins[:-1], changed),
        "near_next": likeness(bins[:-1], bins[1:]),
    })


def fingerprint(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, with their likeness and that of the next text.

    The edited form replaces the last half of the code points by as many from
    the start of the next document, by ascending doc_id, the first following the
    last. Null texts count as empty, rows of one doc_id are ordered by a hash of
    their text, and null ids come first. An empty table gives no rows.

    Texts move once, to ranges of ids and text hashes, so that one id, or none,
    in very many rows is several ranges. A range answers all its rows but the
    last and hands on its first and its last row; the answers are written, and
    the last rows meet the first ones of the ranges behind them.
    """
    spark = docs.sparkSession
    tune(spark)
    low = -(1 << 63)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keys = {"k": F.coalesce("doc_id", F.lit(low)), "h": F.xxhash64("text"), "u": F.monotonically_increasing_id()}
    n = max(_FAN, input_bytes(docs) >> 22)
    ranged = rows.withColumns(keys).repartitionByRange(n, "k", "h", "u").sortWithinPartitions("k", "h", "u")
    written = materialize(ranged.select("doc_id", "text").mapInArrow(_fingerprints, f"{_OUT}, {_EDGES}"))
    firsts, lasts = (written.where(F.col("edge") == edge) for edge in ("first", "last"))
    # Numbers of the ranges that have rows, each with the one behind it: two numbers for each range.
    order = firsts.select("part").withColumn("behind", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())))
    behind = order.join(firsts.select(F.col("part").alias("behind"), F.col("text").alias("next")), "behind").select("part", "next")
    ends = lasts.join(behind, "part").select("doc_id", "text", "next").mapInArrow(_compare_edges, _OUT)
    return written.where("edge IS NULL").drop("part", "edge", "text").unionByName(ends)
