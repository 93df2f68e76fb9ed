"""Hard-negative mining on integer scores, by bit-planes.

Components become integers, and an inner product of integers is the sum over the
bit-planes of one side of the plane's weight times the plane's product with the
other. Planes are taken most significant first. After each, a score is known to
within what the planes below can add, between their weight times the sums of the
anchor's negative and of its positive components, so that a row leaves as soon as
its interval cannot come among the best of an anchor any more.

Anchors are a stated set, every fiftieth id; they go to the tasks in blocks of
bounded size, and every task meets all rows of its own with them. A task keeps the
best few of each anchor and hands on these alone.

Rows with a null vec_id, label or vector, or a null or non-finite component, take
no part; a vector shorter than the longest counts as filled with zeros. Every row
is a row of its own, also one that repeats another or its vec_id; of rows of equal
score and vec_id an arbitrary one comes first. Scores must stay within 55 bits,
which is checked; larger components are an error. Without anchors, positives or
negatives there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.runtime import materialize, tune

SCALE = 256
EVERY = 50  # ids divisible by it are anchors
FLIPPED, LABELS = 7, 10  # ids divisible by the first get the next of so many labels
POSITIVES, NEGATIVES = 5, 3
LEAST, MOST = 50, 95  # hundredths of the positive's score that a negative's lies between
BLOCK = 16 << 20  # bytes of anchors sent at once
ROWS = 1024  # of a batch
WIDTH = 1024  # anchors met at a time
LOWEST = -(1 << 62)  # below every score


def integers(embeddings: DataFrame) -> DataFrame:
    """uid, vec_id, label, v (array of bigint) of the rows that take part."""
    x = F.col("embedding")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    label = F.when(F.col("vec_id") % FLIPPED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & whole)
    return rows.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), F.transform(x, lambda c: F.floor(c.cast("double") * SCALE)).alias("v"))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """The vectors of a list column as int64 rows of dim, filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.zeros((len(column), dim), np.int64)
    size = np.diff(np.asarray(column.offsets)) if len(column) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = column.flatten().to_numpy()
    return out


class Planes:
    """Products of the bit-planes of rows with anchors, most significant plane first.

    floats holds 0 and 1 and the anchors in a type in which their products are
    exact; scores are int64.
    """

    def __init__(self, rows: np.ndarray, anchors: np.ndarray, bits: int, most: int):
        self.rows, self.bits = rows, bits
        self.kind = np.float32 if rows.shape[1] * most < 1 << 24 else np.float64 if rows.shape[1] * most < 1 << 53 else np.int64
        self.anchors = anchors.astype(self.kind)
        self.low, self.high = np.minimum(anchors, 0).sum(axis=1), np.maximum(anchors, 0).sum(axis=1)

    def plane(self, j: int) -> np.ndarray:
        return ((self.rows >> j) & 1).astype(self.kind)

    def weight(self, j: int) -> int:
        return -(1 << j) if j == self.bits - 1 else 1 << j  # the first plane is the sign of two's complement

    def survivors(self, alive: np.ndarray, qualifies) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, anchors and exact scores of the pairs in alive (rows x anchors) that no interval rules out.

        qualifies(low, high, row, anchor) says of pairs whether scores between low
        and high may still count. While many pairs live a plane is one matrix
        product; when few do it is taken for these alone.
        """
        score, j = np.zeros(alive.shape, np.int64), self.bits
        while j and alive.sum() * 8 > alive.size:
            j -= 1
            score += (self.plane(j) @ self.anchors.T).astype(np.int64) * self.weight(j)
            row, anchor = np.nonzero(alive)
            left = (1 << j) - 1
            s = score[row, anchor]
            alive[row, anchor] = qualifies(s + left * self.low[anchor], s + left * self.high[anchor], row, anchor)
        row, anchor = np.nonzero(alive)
        s = score[row, anchor]
        while j and len(row):
            j -= 1
            s = s + np.einsum("ij,ij->i", self.plane(j)[row], self.anchors[anchor]).astype(np.int64) * self.weight(j)
            left = (1 << j) - 1
            keep = qualifies(s + left * self.low[anchor], s + left * self.high[anchor], row, anchor)
            row, anchor, s = row[keep], anchor[keep], s[keep]
        return row, anchor, s


class Best:
    """The best k (score, then smaller id) of each of n groups, as tables of k columns."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.id, self.uid = np.full((n, k), LOWEST), np.zeros((n, k), np.int64), np.zeros((n, k), np.int64)

    @property
    def bound(self) -> np.ndarray:
        """The score that the last of a group has; LOWEST while there are fewer."""
        return self.score[:, -1]

    def add(self, group: np.ndarray, score: np.ndarray, id_: np.ndarray, uid: np.ndarray) -> None:
        new = score >= self.bound[group]
        touched = np.unique(group[new])
        every = np.concatenate([np.repeat(touched, self.k), group[new]])
        columns = [np.concatenate([old[touched].ravel(), x[new]]) for old, x in ((self.score, score), (self.id, id_), (self.uid, uid))]
        order = np.lexsort((columns[2], columns[1], -columns[0], every))
        every = every[order]
        kept = order[np.arange(len(every)) - np.searchsorted(every, every) < self.k]
        for table, x in zip((self.score, self.id, self.uid), columns):
            table[touched] = x[kept].reshape(-1, self.k)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """group, score, id, uid of all that there are."""
        group, place = np.nonzero(self.score != LOWEST)
        return group, self.score[group, place], self.id[group, place], self.uid[group, place]


def _blocks(anchors: DataFrame, dim: int) -> list[DataFrame]:
    n = max(1, -(-anchors.count() * (dim + 4) * 8 // BLOCK))
    return [anchors.where(F.pmod(F.xxhash64("uid"), F.lit(n)) == i) for i in range(n)]


def _batches(batches: Iterator[pa.RecordBatch], dim: int):
    for batch in batches:
        if batch.num_rows:
            yield *(batch.column(c).to_numpy() for c in ("uid", "vec_id", "label")), matrix(batch.column("v"), dim)


def _positives(rows: DataFrame, block: DataFrame, dim: int, bits: int, most: int) -> DataFrame:
    """anchor, anchor_id, uid, vec_id, score: what each task finds best of an anchor's own label."""
    t = block.toArrow()
    label = t.column("label").to_numpy()
    order = np.argsort(label, kind="stable")
    sent = rows.sparkSession.sparkContext.broadcast((t.column("uid").to_numpy()[order], t.column("vec_id").to_numpy()[order], label[order], matrix(t.column("v"), dim)[order]))

    def run(batches: Iterator[pa.RecordBatch]):
        a_uid, a_id, a_label, a = sent.value
        best = Best(len(a_uid), POSITIVES)
        for uid, vec_id, label, v in _batches(batches, dim):
            for one in np.unique(label):
                at = np.flatnonzero(label == one)
                for lo in range(*np.searchsorted(a_label, (one, one + 1)).tolist(), WIDTH):
                    hi = min(lo + WIDTH, int(np.searchsorted(a_label, one + 1)))
                    other = uid[at][:, None] != a_uid[None, lo:hi]
                    bound = best.bound[lo:hi]
                    row, anchor, score = Planes(v[at], a[lo:hi], bits, most).survivors(other, lambda low, high, row, anchor, bound=bound: high >= bound[anchor])
                    best.add(anchor + lo, score, vec_id[at][row], uid[at][row])
        i, score, id_, uid = best.rows()
        yield pa.RecordBatch.from_pydict({"anchor": a_uid[i], "anchor_id": a_id[i], "uid": uid, "vec_id": id_, "score": score})

    return rows.mapInArrow(run, "anchor bigint, anchor_id bigint, uid bigint, vec_id bigint, score bigint")


def _negatives(rows: DataFrame, block: DataFrame, dim: int, bits: int, most: int) -> DataFrame:
    """anchor, anchor_id, positive, positive_id, positive_score, uid, vec_id, score: what each task finds best of other labels for an anchor and each of its positives, block having these as lists."""
    t = block.toArrow()
    p = t.column("positives").to_pylist()
    shape = len(p), POSITIVES
    pos, pid, ps = np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.full(shape, -1)
    for i, some in enumerate(p):
        for j, x in enumerate(some):
            pos[i, j], pid[i, j], ps[i, j] = x["uid"], x["vec_id"], x["score"]
    # Whole scores n with LEAST p <= 100 n <= MOST p; a negative p has none.
    least, most_n = -(-LEAST * ps // 100), np.where(ps >= 0, MOST * ps // 100, LOWEST)
    sent = rows.sparkSession.sparkContext.broadcast((t.column("uid").to_numpy(), t.column("vec_id").to_numpy(), t.column("label").to_numpy(), matrix(t.column("v"), dim), pos, pid, ps, least, most_n))

    def run(batches: Iterator[pa.RecordBatch]):
        a_uid, a_id, a_label, a, pos, pid, ps, least, most_n = sent.value
        best = Best(len(a_uid) * POSITIVES, NEGATIVES)
        for uid, vec_id, label, v in _batches(batches, dim):
            for lo in range(0, len(a_uid), WIDTH):
                hi = min(lo + WIDTH, len(a_uid))
                floor = np.maximum(least[lo:hi], best.bound.reshape(-1, POSITIVES)[lo:hi])

                def within(low, high, row, anchor, floor=floor, top=most_n[lo:hi]):
                    return np.logical_or.reduce([(high >= floor[anchor, p]) & (low <= top[anchor, p]) for p in range(POSITIVES)])

                row, anchor, score = Planes(v, a[lo:hi], bits, most).survivors(label[:, None] != a_label[None, lo:hi], within)
                for p in range(POSITIVES):
                    hit = (score >= floor[anchor, p]) & (score <= most_n[lo:hi][anchor, p])
                    best.add((anchor[hit] + lo) * POSITIVES + p, score[hit], vec_id[row[hit]], uid[row[hit]])
        group, score, id_, uid = best.rows()
        i, j = group // POSITIVES, group % POSITIVES
        yield pa.RecordBatch.from_pydict({"anchor": a_uid[i], "anchor_id": a_id[i], "positive": pos[i, j], "positive_id": pid[i, j], "positive_score": ps[i, j], "uid": uid, "vec_id": id_, "score": score})

    return rows.mapInArrow(run, "anchor bigint, anchor_id bigint, positive bigint, positive_id bigint, positive_score bigint, uid bigint, vec_id bigint, score bigint")


def _top(found: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id", "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(embeddings: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: the hardest negatives of every anchor and positive."""
    tune(embeddings.sparkSession, ROWS)
    rows = materialize(integers(embeddings))
    shape = rows.agg(F.max(F.size("v")).alias("dim"), F.max(F.array_max(F.transform("v", lambda c: F.greatest(c, -1 - c)))).alias("most")).first()
    dim, most = shape["dim"] or 0, shape["most"] or 0
    bits, most = most.bit_length() + 1, most + 1
    if dim * most * most >= 1 << 55:
        raise ValueError(f"components of {most} in {dim} dimensions have products beyond 55 bits")
    out = None
    for block in _blocks(rows.where(F.col("vec_id") % EVERY == 0), dim):
        near = materialize(_top(_positives(rows, block, dim, bits, most), POSITIVES, "anchor"))
        lists = near.groupBy("anchor").agg(F.collect_list(F.struct("uid", "vec_id", "score")).alias("positives"))
        known = block.join(lists, F.col("uid") == F.col("anchor")).select("uid", "vec_id", "label", "v", "positives")
        part = materialize(_top(_negatives(rows, known, dim, bits, most), NEGATIVES, "anchor", "positive"))
        out = part if out is None else out.unionByName(part)
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
