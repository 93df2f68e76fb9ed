"""Filter interaction audit: what every order of five filters keeps and removes, from one incidence matrix.

Each document fails some of the filters A to E, which makes a mask of five bits.
The documents of a part are then a histogram over 32 masks, once of all, once of
the good and once of the toxic ones, and every outcome of every order is such a
row times an integer matrix of 32 rows (masks) by 600 columns (120 orders of
five steps).

A: under 200 words. B: fewer than half of the words distinct. C: over 3 % of the
code points in A-Z. D: holds one of #$%&*|. E: the same text as a smaller doc_id.
Words are maximal runs other than ASCII white space, in their own case; a null
text is empty (it fails A; and E where a smaller doc_id has an empty text), a
null lang the part ''. A document without labels is neither good nor toxic, one
with several label rows whatever any of them says. Rows of one doc_id and text
are both the first of their text; a row without doc_id never fails E, nor makes
another fail it. A table without rows has no parts and no result.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MASKS = 1 << len(FILTERS)
SPACE = " \t\n\x0b\x0c\r"


def outcome_matrices() -> dict[str, np.ndarray]:
    """kept, removed, redundant and unique: for each mask (rows) whether that is its outcome at each step of each order (columns, step after step)."""
    bit = np.array([[1 << FILTERS.index(f) for f in o] for o in ORDERS])
    before = np.cumsum(bit, axis=1) - bit
    bit, before = bit.ravel(), before.ravel()
    mask = np.arange(MASKS)[:, None]
    fails, gone = (mask & bit) > 0, (mask & before) > 0
    found = {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique": mask == bit}
    return {k: v.astype(np.int64) for k, v in found.items()}


def failures(text: Column) -> list[Column]:
    """Whether a text (not null) fails A, B, C, D; evaluated over columns words and n_words beside it."""
    words, n = F.col("words"), F.col("n_words")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [n < 200, 100 * F.size(F.array_distinct(words)).cast("bigint") < 50 * n, 100 * capitals.cast("bigint") > 3 * F.length(text).cast("bigint"), text.rlike("[#$%&*|]")]


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text and the mask of A to D of every row."""
    plain = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    bare = F.btrim("text", F.lit(SPACE))
    split = plain.select("*", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+")).alias("words"))
    counted = split.withColumn("n_words", F.size("words").cast("bigint"))
    mask = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(failures(F.col("text")))), F.lit(0))
    return counted.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.cast("int").alias("mask"))


def histogram(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents of each part and mask of all five filters.

    Rows are summed before they meet: by text, part, mask and doc_id, then, with
    their labels, by all but doc_id, so that copies, however many, are a few rows
    when the least doc_id of their text is looked for.
    """
    rows = masks(docs).groupBy("digest", "part", "mask", "doc_id").agg(F.count("*").alias("n"))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("marked")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    known = rows.where("doc_id IS NOT NULL").join(marks, F.col("doc_id") == F.col("marked"), "left").drop("marked")
    none = rows.where("doc_id IS NULL").select("*", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    marked = known.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")}).unionByName(none)
    groups = marked.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.coalesce(F.min_by("n", "doc_id"), F.lit(0)).alias("n_least"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("n_null")
    )
    first = groups.withColumn("first", F.min("least").over(Window.partitionBy("digest")))
    passing = F.col("n_null") + F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0)
    both = F.array(F.struct(F.col("mask"), passing.alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(16)).alias("mask"), (F.col("n") - passing).alias("n")))
    each = first.select("part", "good", "toxic", F.explode(both).alias("x")).select("part", "good", "toxic", "x.mask", "x.n").where("n > 0")
    return each.groupBy("part", "mask").agg(F.sum("n").alias("n"), *(F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")))


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def outcomes(hist: np.ndarray, matrices: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The counts of every step of every order for a part's rows n, good and toxic over the masks."""
    removed = hist @ matrices["removed"]
    letter = np.array([FILTERS.index(f) for o in ORDERS for f in o])
    shapley = np.zeros(len(FILTERS), np.int64)
    np.add.at(shapley, letter, removed[0])
    found = hist[0] @ matrices["kept"], removed[0], hist[0] @ matrices["redundant"], hist[0] @ matrices["unique"], removed[1], removed[2], shapley[letter]
    return dict(zip(COUNTS, found))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows for each part.

    A part comes to Python as its 32 masks at most; parts are dealt among the tasks.
    """
    parts = histogram(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("rows"))
    matrices = outcome_matrices()
    size = len(FILTERS)

    def multiply(batches):
        for batch in batches:
            for part, rows in zip(batch.column("part").to_pylist(), batch.column("rows").to_pylist()):
                hist = np.zeros((3, MASKS), np.int64)
                for r in rows:
                    hist[:, r["mask"]] = r["n"], r["good"], r["toxic"]
                steps = np.tile(np.arange(1, size + 1, dtype=np.int32), len(ORDERS))
                yield pa.RecordBatch.from_pydict({"part": [part] * len(steps), "filter_order": [o for o in ORDERS for _ in range(size)], "step": steps, **outcomes(hist, matrices)})

    return parts.mapInArrow(multiply, "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COUNTS))
