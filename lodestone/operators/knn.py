"""Exact search: distances, top k, re-ranking, product quantisation.

Tables: vectors (id, vec), queries (qid, qvec). Where every pair is wanted, a
query set is broadcast if its size is checked to be within QUERY_BYTES and met in
blocks of that size beyond. Where only the nearest are, pairs become rows up to
PAIRS of them; beyond, queries and vectors meet in the cells of a grid.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.window import Window

from lodestone.functions import UNROLL, l2sq
from lodestone.operators.snapshot import materialize

QUERY_BYTES = 64 << 20
PAIRS = 1 << 20  # pairs of a query and a vector that become rows, at most; beyond, a grid's cells keep the nearest


def dimension(vectors: DataFrame, column: str = "vec") -> int | None:
    """Elements of the first vector; None for an empty table."""
    row = vectors.select(F.size(column).alias("n")).first()
    return row["n"] if row else None


def blocks(queries: DataFrame) -> list[DataFrame]:
    """queries as frames that are each small enough to broadcast."""
    size = int(str(queries._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size <= QUERY_BYTES:
        return [F.broadcast(queries)]
    width = queries.agg(F.sum(F.size("qvec") * 8 + 32)).first()[0] or 0
    n = -(-int(width) // QUERY_BYTES) or 1
    return [F.broadcast(queries.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == i)) for i in range(n)]


def pairs(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Every vector beside every query, for a limit on what follows; queries come in blocks of a checked size."""
    return reduce(DataFrame.unionAll, [vectors.crossJoin(q) for q in blocks(queries)])


def distances(queries: DataFrame, vectors: DataFrame, dim: int | None = None) -> DataFrame:
    """qid, id, dist (and other columns of vectors) of every query with every vector."""
    dim = dim or dimension(vectors)
    return pairs(queries, vectors).withColumn("dist", l2sq(F.col("qvec"), F.col("vec"), dim)).drop("qvec", "vec")


def top(df: DataFrame, by: str, k: int, *order: str | Column, rank: str = "rk") -> DataFrame:
    """The k first rows of each group; ties must be settled by the order given."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(by).orderBy(*(order or ("dist", "id"))))).where(F.col(rank) <= k)


def knn(queries: DataFrame, vectors: DataFrame, k: int = 10, deleted: DataFrame | None = None, dim: int | None = None, n_pairs: int | None = None) -> DataFrame:
    """qid, rk, id, dist: the k nearest vectors that are not deleted; fewer rows where there are fewer. n_pairs, where it is known, saves counting."""
    live = vectors.join(deleted, "id", "left_anti") if deleted is not None else vectors
    dim = dim or dimension(vectors)
    if (queries.count() * vectors.count() if n_pairs is None else n_pairs) > PAIRS:
        return nearest(queries, live, k, dim)
    return top(distances(queries, live.select("id", "vec"), dim), "qid", k).select("qid", "rk", "id", "dist")


# ---- a grid of queries and vectors, whose cells keep only what can be among the nearest


CELL = 32 << 20  # bytes of the queries, and of the vectors, of a cell, about
STRIP, TILE = 256, 2048  # queries and vectors of a cell that a product takes at a time
WORK = 1 << 24  # pairs that are worth a task, as long as there are fewer cells than cores
EXACT = 1 << 14  # distances computed at a time
WILD, TINY = 1e15, 1e-30  # beyond, squares may overflow in single precision: such vectors are met without the estimate; what is less may be lost there
SOME = np.iinfo(np.int64).min  # stands for a null id, which comes first


def nearest(queries: DataFrame, vectors: DataFrame, k: int, dim: int | None = None) -> DataFrame:
    """qid, rk, id, dist, as knn; of equal vectors only the first k by id meet the queries."""
    few = top(vectors.select("id", "vec"), "vec", k, "id").drop("rk")
    found = _grid(queries.select("qid", "qvec", F.lit(None).cast("double").alias("bound")), few, k, dim or dimension(vectors))
    return top(found, "qid", k).select("qid", "rk", "id", "dist")


def within(queries: DataFrame, vectors: DataFrame, dim: int | None = None) -> DataFrame:
    """qid, id, dist of all vectors no farther than the bound of a query (qid, qvec, bound); null distances are not."""
    return _grid(queries.where("bound IS NOT NULL"), vectors, 0, dim or dimension(vectors))


def _grid(queries: DataFrame, vectors: DataFrame, k: int, dim: int | None) -> DataFrame:
    """qid, id, dist of the k nearest in each cell, or with k = 0 of what is within the bound.

    Queries and vectors are dealt by a hash into rows and columns of about CELL
    bytes, fewer where cores would be idle; each cell is a partition of its own,
    in which vectors stream by the queries. What leaves it are the answers.
    """
    dim = dim or 1
    n, m = queries.count(), vectors.count()
    n_rows, n_columns = (-(-x * 8 * dim // CELL) or 1 for x in (n, m))
    n_columns = max(n_columns, min(queries.sparkSession.sparkContext.defaultParallelism, n * m // WORK) // n_rows)
    whole = lambda c: (F.size(c) >= dim if dim <= UNROLL else F.size(c) == dim) & ~F.exists(F.slice(c, 1, dim), lambda x: x.isNull())
    plain = lambda c: F.when(whole(c), F.slice(F.col(c).cast("array<double>"), 1, dim)).alias("vec")
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select(F.lit(False).alias("base"), F.col("qid").alias("id"), plain("qvec"), F.col("bound").cast("double"), deal("qid", n_rows).alias("row"), every(n_columns).alias("column"))
    given = vectors.select(F.lit(True).alias("base"), "id", plain("vec"), F.lit(None).cast("double").alias("bound"), deal("id", n_columns).alias("column"), every(n_rows).alias("row"))
    both = asked.unionByName(given).select((F.col("row") * n_columns + F.col("column")).alias("cell"), "base", F.coalesce(F.col("id").cast("bigint"), F.lit(SOME)).alias("id"), "vec", "bound")
    cells = both.repartitionById(n_rows * n_columns, F.col("cell")).sortWithinPartitions("cell", "base")

    def feed(cell: Cell, base: bool, part: pa.RecordBatch):
        ids, rows = part.column("id").to_numpy(), _rows(part.column("vec"), dim)
        if base:
            yield from cell.meet(ids, *rows)
        else:
            cell.ask(ids, *rows, part.column("bound").to_numpy(zero_copy_only=False))

    def run(batches: Iterator[pa.RecordBatch]):
        return _through(batches, lambda: Cell(k, dim), feed)

    null = lambda c: F.when(F.col(c) != SOME, F.col(c)).alias(c)
    return cells.mapInArrow(run, "qid bigint, id bigint, dist double").select(null("qid"), null("id"), F.when(F.col("dist") >= 0, F.col("dist")).alias("dist"))


def _through(batches: Iterator[pa.RecordBatch], begin, feed):
    """Batches sorted by cell, its queries first, fed to a Cell each; what feed gives, and the answers of cells that keep them."""
    cell, now = None, None
    for batch in batches:
        key = batch.column("cell").to_numpy().astype(np.int64) * 2 + batch.column("base").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if cell != key[a] // 2:
                if now is not None and now.k:
                    yield _batch(now.answers())
                cell, now = key[a] // 2, begin()
            yield from map(_batch, feed(now, bool(key[a] % 2), batch.slice(a, b - a)))
    if now is not None and now.k:
        yield _batch(now.answers())


def _rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a list column as rows of dim, zeros for null ones, and which are null."""
    null = column.is_null().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dim))
    out[~null] = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return out, null


class Cell:
    """Queries of a cell with the k nearest vectors (distance, then smaller id) that they have met.

    |v|^2 - 2 q v, in single precision, says what is farther than a query's last
    by more than its error can be; all else is computed again, from left to right.
    A null distance is -1 here, so that it comes first, and NaN comes last.
    """

    def __init__(self, k: int, dim: int):
        self.k, self.dim, self.parts = k, dim, []

    def ask(self, ids: np.ndarray, q: np.ndarray, null: np.ndarray, bound: np.ndarray) -> None:
        self.parts.append((ids, q, null, bound))

    def _begin(self) -> None:
        self.qid, self.q, self.q_null, self.bound = (np.concatenate(x) for x in zip(*self.parts))
        self.parts = []
        self.q_wild, plain, self.q_norm = _estimable(self.q, self.q_null)
        self.q_short = np.concatenate([-2.0 * plain, np.ones((len(plain), 1))], axis=1).astype(np.float32)
        if self.k:
            self.dist, self.id = np.full((len(self.q), self.k), np.inf), np.zeros((len(self.q), self.k), np.int64)
            self.n = np.zeros(len(self.q), np.int64)

    def meet(self, ids: np.ndarray, v: np.ndarray, v_null: np.ndarray):
        """Meet vectors; without k, ids of queries and vectors and distances of what is within the bounds."""
        if self.parts:
            self._begin()
        if not hasattr(self, "q") or not len(ids):
            return  # a cell without queries
        v_wild, plain, v_norm = _estimable(v, v_null)
        v_short = np.ascontiguousarray(np.concatenate([plain, v_norm[:, None]], axis=1).T, dtype=np.float32)
        width = max(TILE, 4 * self.k)
        for a in range(0, len(self.q), STRIP):
            strip = slice(a, a + STRIP)
            slack = 4 * (self.dim + 8) * np.finfo(np.float32).eps * (self.q_norm[strip] + v_norm.max()) + TINY
            if self.k:
                full = self.n[strip] == self.k
                last = np.where(full & ~np.isnan(self.dist[strip, -1]), self.dist[strip, -1], np.inf)
            else:
                full, last = np.ones(len(slack), bool), np.where(np.isnan(self.bound[strip]), np.inf, self.bound[strip])
            most = np.where(np.isfinite(last), last - self.q_norm[strip] + slack, np.inf)
            most, bare = np.minimum(most, np.finfo(np.float32).max), ~full
            at, est = [], []
            for b in range(0, len(ids), width):
                tile = slice(b, b + width)
                far = self.q_short[strip] @ v_short[:, tile]
                tame = ~v_wild[tile]
                if bare.any() and np.count_nonzero(tame) >= self.k:  # the k-th of a tile is a bound for the rest
                    near = far[bare] if tame.all() else far[np.ix_(bare, tame)]
                    most[bare] = np.minimum(most[bare], np.partition(near, self.k - 1, axis=1)[:, self.k - 1] + 2 * slack[bare])
                    bare[:] = False
                far[:, ~tame] = -np.inf
                far[self.q_wild[strip]] = -np.inf
                found = np.flatnonzero(far <= most.astype(np.float32)[:, None])
                at.append(found // far.shape[1] * len(ids) + found % far.shape[1] + b)
                est.append(far.ravel()[found])
            i, j = np.divmod(np.concatenate(at), len(ids))
            if not full.all():
                kept = _least(i, np.concatenate(est), self.k, slack)
                i, j = i[kept], j[kept]
            if not len(i):
                continue
            i += a
            dist = np.concatenate([self._exact(i[x : x + EXACT], j[x : x + EXACT], v) for x in range(0, len(i), EXACT)])
            dist[self.q_null[i] | v_null[j]] = -1.0
            if self.k:
                self._keep(i, ids[j], dist)
            else:
                # NaN is the largest double, as in Spark
                ok = (dist >= 0) & ((dist <= self.bound[i]) | np.isnan(self.bound[i])) | np.isnan(dist) & np.isnan(self.bound[i])
                yield self.qid[i[ok]], ids[j[ok]], dist[ok]

    def _exact(self, i: np.ndarray, j: np.ndarray, v: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            d = self.q[i] - v[j]
            return np.cumsum(d * d, axis=1)[:, -1]

    def _keep(self, i: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> None:
        rows = np.unique(i)
        n = self.n[rows]
        had = np.arange(self.k) < n[:, None]
        i = np.concatenate([np.repeat(rows, n), i])
        dist, ids = np.concatenate([self.dist[rows][had], dist]), np.concatenate([self.id[rows][had], ids])
        order = np.lexsort((ids, dist, i))
        i, dist, ids = i[order], dist[order], ids[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        kept = place < self.k
        i, place = i[kept], place[kept]
        self.dist[i, place], self.id[i, place] = dist[kept], ids[kept]
        self.n[rows] = np.searchsorted(i, rows, side="right") - np.searchsorted(i, rows)

    def answers(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not hasattr(self, "q"):
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.float64))
        had = np.arange(self.k) < self.n[:, None]
        return np.repeat(self.qid, self.n), self.id[had], self.dist[had]


def _least(i: np.ndarray, est: np.ndarray, k: int, slack: np.ndarray) -> np.ndarray:
    """Which estimates est of queries i can be among the k least of their query; -inf is no estimate and stays."""
    ranked = np.where(np.isneginf(est), np.inf, est)
    order = np.lexsort((ranked, i))
    place = np.searchsorted(i[order], np.arange(len(slack))) + k - 1
    there = place < np.searchsorted(i[order], np.arange(len(slack)), side="right")
    most = np.full(len(slack), np.inf)
    most[there] = ranked[order][place[there]] + 2 * slack[there]
    return est <= most[i]


def _batch(columns: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["qid", "id", "dist"])


def _estimable(x: np.ndarray, null: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows of x have no estimate, x with zeros for these, and its squared lengths."""
    wild = null | ~(np.abs(x) < WILD).all(axis=1)
    plain = np.where(wild[:, None], 0.0, x) if wild.any() else x
    return wild, plain, np.einsum("ij,ij->i", plain, plain)


TABLE_BYTES = 256 << 20  # vectors that a table function sends to the tasks
SCAN = 1 << 14  # of them whose distances it computes at a time


def register_knn(spark: SparkSession, vectors: DataFrame, name: str = "knn") -> None:
    """The SQL table function name(query_vec, k): rk, id, dist of the k nearest of vectors, for FROM queries, LATERAL knn(queries.vec, 10).

    Vectors are sent to the tasks, up to TABLE_BYTES; beyond, use knn(). They go
    as single precision where that is all they have; distances are computed for
    those alone that a product does not rule out, SCAN at a time, so that a task
    needs little more than they take.
    """
    rows = vectors.select("id", "vec").orderBy("id", "vec")
    short = F.forall("vec", lambda x: (x.cast("float").cast("double") == x.cast("double")) | x.isNull())
    length = F.when(F.col("vec").isNull() | F.exists("vec", lambda x: x.isNull()), -1).otherwise(F.size("vec"))
    n, single, least, most = rows.agg(F.sum(F.size("vec")), F.coalesce(F.bool_and(short), F.lit(True)), F.min(length), F.max(length)).first()
    if least != most or least == -1:
        raise ValueError("vectors of a table function have one dimension and no nulls")
    size = (n or 0) * (4 if single else 8) + rows.count() * 16
    if size > TABLE_BYTES:
        raise ValueError(f"{size} bytes of vectors are more than a table function is sent")
    table = (rows.withColumn("vec", F.col("vec").cast("array<float>")) if single else rows).toArrow()
    ids, column = table.column("id").to_numpy(), table.column("vec").combine_chunks()
    vecs = column.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1) if len(ids) else np.zeros((0, 1))
    sent = spark.sparkContext.broadcast((ids, vecs, np.einsum("ij,ij->i", vecs, vecs, dtype=np.float64)))

    class Nearest:
        def eval(self, query_vec, k):
            ids, vecs, norms = sent.value
            if query_vec is None or k is None or not len(ids):
                return
            q = np.asarray(query_vec, np.float64)
            at = _near(vecs, norms, q, k)
            parts = [vecs[at[a : a + SCAN]] - q for a in range(0, len(at), SCAN)]
            dist = np.concatenate([np.cumsum(d * d, axis=1)[:, -1] for d in parts])  # from left to right, as everywhere
            for i, j in enumerate(np.lexsort((ids[at], dist))[:k]):
                yield i + 1, int(ids[at[j]]), float(dist[j])

    spark.udtf.register(name, udtf(Nearest, returnType="rk int, id bigint, dist double"))


def _near(vecs: np.ndarray, norms: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    """Places of the vectors that can be among the k nearest to q: all that |v|^2 - 2 q v does not rule out by more than its error."""
    most, length = norms.max(), q @ q
    if not 0 < k < len(vecs) or not (most < 1e30 and length < 1e30):
        return np.arange(len(vecs))
    e = 4 * (len(q) + 8) * np.finfo(vecs.dtype).eps
    far = norms - 2.0 * (vecs @ q.astype(vecs.dtype))
    last = np.partition(far + e * norms, k - 1)[k - 1] + 2 * e * length
    return np.flatnonzero(far - e * norms <= last)


def rerank(candidates: DataFrame, queries: DataFrame, vectors: DataFrame, k: int = 10, dim: int | None = None) -> DataFrame:
    """Top k of candidate pairs (qid, id) by exact distance."""
    dim = dim or dimension(vectors)
    both = candidates.select("qid", "id").join(vectors.select("id", "vec"), "id").join(F.broadcast(queries) if len(blocks(queries)) == 1 else queries, "qid")
    return top(both.withColumn("dist", l2sq(F.col("qvec"), F.col("vec"), dim)), "qid", k).select("qid", "rk", "id", "dist")


# ---- product quantisation: chunks of equal width, pivots (chunk, code, sub), codes (id, chunk, code)


def chunks(df: DataFrame, column: str, n: int, width: int) -> DataFrame:
    """One row per chunk of a vector: its number and its part of the vector."""
    parts = F.array(*(F.slice(column, c * width + 1, width) for c in range(n)))
    return df.select("*", F.posexplode(parts).alias("chunk", "part")).drop(column)


def pivots(vectors: DataFrame, m: int = 16, n: int = 8, width: int = 8) -> DataFrame:
    """Stand-ins for trained pivots: the parts of the vectors 0 to m - 1."""
    return chunks(vectors.where(F.col("id") < m).select("id", "vec"), "vec", n, width).select("chunk", F.col("id").cast("int").alias("code"), F.col("part").alias("sub"))


def train_pivots(vectors: DataFrame, codes: int = 256, n: int = 8, width: int = 8, seed: int = 7) -> DataFrame:
    """Pivots by k-means in every chunk."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    parts = chunks(vectors.select("id", "vec"), "vec", n, width).select("chunk", array_to_vector("part").alias("features"))
    rows = []
    for c in range(n):
        model = KMeans(k=codes, seed=seed, maxIter=10).fit(parts.where(F.col("chunk") == c))
        rows += [(c, i, [float(x) for x in center]) for i, center in enumerate(model.clusterCenters())]
    return vectors.sparkSession.createDataFrame(rows, "chunk int, code int, sub array<double>")


def refine_pivots(vectors: DataFrame, pivots: DataFrame, rounds: int = 2, n: int = 8, width: int = 8) -> DataFrame:
    """Pivots (chunk, code, sub) after rounds of k-means from the given ones, every chunk on its own, to nine digits; a pivot without parts stays.

    Parts are summed where they are; what moves is one sum for each task, chunk and code.
    """
    for _ in range(rounds):
        parts = chunks(vectors.select("id", "vec"), "vec", n, width)
        mine = encode(vectors, pivots, n, width).join(parts, ["id", "chunk"])
        mean = mine.groupBy("chunk", "code").agg(F.array(*(F.round(F.avg(F.get("part", F.lit(i))), 9) for i in range(width))).alias("mean"))
        pivots = pivots.join(mean, ["chunk", "code"], "left").select("chunk", "code", F.coalesce("mean", "sub").alias("sub"))
    return pivots


def encode(vectors: DataFrame, pivots: DataFrame, n: int = 8, width: int = 8) -> DataFrame:
    """id, chunk, code: the nearest pivot of every part, the lower code on ties."""
    near = chunks(vectors.select("id", "vec"), "vec", n, width).join(F.broadcast(pivots), "chunk")  # at most 256 pivots a chunk
    d = l2sq(F.col("part"), F.col("sub"), width)
    return near.groupBy("id", "chunk").agg(F.min_by("code", F.struct(d, "code")).alias("code"))


def distance_table(queries: DataFrame, pivots: DataFrame, n: int = 8, width: int = 8) -> DataFrame:
    """qid, chunk, code, d2: distance of every query part to every pivot."""
    parts = chunks(queries.select("qid", "qvec"), "qvec", n, width).join(F.broadcast(pivots), "chunk")
    return parts.select("qid", "chunk", "code", l2sq(F.col("part"), F.col("sub"), width).alias("d2"))


def adc(codes: DataFrame, table: DataFrame) -> DataFrame:
    """qid, id, dist: sums of table distances over the chunks, to nine digits; every pair is a row, for the nearest use adc_top."""
    return codes.join(table, ["chunk", "code"]).groupBy("qid", "id").agg(F.round(F.sum("d2"), 9).alias("dist"))


def adc_top(codes: DataFrame, table: DataFrame, k: int) -> DataFrame:
    """qid, rk, id, dist: the k first of adc by (dist, id) of each query, through a grid as in nearest.

    A cell holds the tables of its queries, codes stream by, and what leaves it
    are k rows for each query; of equal codes the first k by id take part.
    """
    key = (F.shiftleft(F.col("chunk").cast("bigint"), 32) + F.col("code")).alias("key")
    coded = codes.select("id", key).groupBy("id").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    given = materialize(top(coded, "keys", k, "id").drop("rk"))
    entries = table.select("qid", key, "d2").where("key IS NOT NULL").groupBy("qid").agg(F.collect_list(F.struct("key", "d2")).alias("x"))
    asked = materialize(entries.select("qid", F.col("x.key").alias("keys"), F.col("x.d2").alias("d2")))
    (n, n_entries), (m, n_keys) = (x.agg(F.count("*"), F.coalesce(F.sum(F.size("keys")), F.lit(0))).first() for x in (asked, given))
    n_rows, n_columns = -(-n_entries * 16 // CELL) or 1, -(-(n_keys + 4 * m) * 8 // CELL) or 1
    n_columns = max(n_columns, min(codes.sparkSession.sparkContext.defaultParallelism, n * m // WORK) // n_rows)
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = asked.select(F.lit(False).alias("base"), F.col("qid").alias("id"), "keys", "d2", deal("qid", n_rows).alias("row"), every(n_columns).alias("column"))
    given = given.select(F.lit(True).alias("base"), "id", "keys", F.lit(None).cast("array<double>").alias("d2"), deal("id", n_columns).alias("column"), every(n_rows).alias("row"))
    both = asked.unionByName(given).select((F.col("row") * n_columns + F.col("column")).alias("cell"), "base", F.coalesce(F.col("id").cast("bigint"), F.lit(SOME)).alias("id"), "keys", "d2")
    cells = both.repartitionById(n_rows * n_columns, F.col("cell")).sortWithinPartitions("cell", "base")

    def feed(cell: Sums, base: bool, part: pa.RecordBatch):
        ids, keys = part.column("id").to_numpy(), part.column("keys")
        cell.meet(ids, keys) if base else cell.ask(ids, keys, part.column("d2"))
        return ()

    def run(batches: Iterator[pa.RecordBatch]):
        return _through(batches, lambda: Sums(k), feed)

    null = lambda c: F.when(F.col(c) != SOME, F.col(c)).alias(c)
    found = cells.mapInArrow(run, "qid bigint, id bigint, dist double").select(null("qid"), null("id"), F.when(F.col("dist") != F.lit(-np.inf), F.col("dist")).alias("dist"))
    return top(found, "qid", k).select("qid", "rk", "id", "dist")


class Sums(Cell):
    """Queries of a cell, by their tables (key, d2), with the k vectors of the least sums over keys that they have met.

    A vector none of whose keys a query has is no pair; where all that it has
    are null, the sum is null, -inf here, so that it comes first. Sums are in
    DOUBLE, in order of the keys, to nine digits.
    """

    def __init__(self, k: int):
        self.k, self.parts = k, []

    def ask(self, ids: np.ndarray, keys: pa.Array, d2: pa.Array) -> None:
        null = d2.flatten().is_null().to_numpy(zero_copy_only=False)
        values = np.where(null, 0.0, d2.flatten().to_numpy(zero_copy_only=False))
        self.parts.append((ids, keys.value_lengths().to_numpy(), keys.flatten().to_numpy(), values, null))

    def _begin(self) -> None:
        self.q, lengths, keys, values, null = (np.concatenate(x) for x in zip(*self.parts))
        self.qid, self.parts = self.q, []
        self.keys, at = np.unique(keys, return_inverse=True)
        i = np.repeat(np.arange(len(self.q)), lengths)
        # the last row is of keys that no query has; level: 2 where there is a number, 1 where it is null
        self.table, self.level = np.zeros((len(self.keys) + 1, len(self.q))), np.zeros((len(self.keys) + 1, len(self.q)), np.int8)
        with np.errstate(all="ignore"):
            np.add.at(self.table, (at, i), values)
        np.maximum.at(self.level, (at, i), np.where(null, 1, 2).astype(np.int8))
        self.dist, self.id = np.full((len(self.q), self.k), np.inf), np.zeros((len(self.q), self.k), np.int64)
        self.n = np.zeros(len(self.q), np.int64)

    def meet(self, ids: np.ndarray, keys: pa.Array) -> None:
        if self.parts:
            self._begin()
        if not hasattr(self, "q") or not len(ids):
            return  # a cell without queries
        lengths, flat = keys.value_lengths().to_numpy(), keys.flatten().to_numpy()
        place = np.searchsorted(self.keys[:-1], flat)
        place[self.keys[place] != flat] = len(self.keys)
        at = np.full((len(ids), max(1, lengths.max())), len(self.keys))
        at[np.arange(at.shape[1]) < lengths[:, None]] = place
        for a in range(0, len(self.q), STRIP):
            table, level = (np.ascontiguousarray(x[:, a : a + STRIP]) for x in (self.table, self.level))
            for b in range(0, len(ids), TILE):
                self._tile(a, ids[b : b + TILE], at[b : b + TILE], table, level)

    def _tile(self, a: int, ids: np.ndarray, at: np.ndarray, table: np.ndarray, level: np.ndarray) -> None:
        strip = slice(a, a + table.shape[1])
        with np.errstate(all="ignore"):
            far = table[at[:, 0]]
            for c in range(1, at.shape[1]):
                far += table[at[:, c]]
        there = None
        if (level[:-1] < 2).any() or at.max() == len(table) - 1:
            most = reduce(np.maximum, (level[at[:, c]] for c in range(at.shape[1])))
            far[most == 1], there = -np.inf, most > 0
        last = np.where(self.n[strip] == self.k, self.dist[strip, -1], np.inf)
        bare = self.n[strip] < self.k
        if bare.any() and len(ids) >= self.k:  # the k-th of a tile is a bound for the rest
            near = far[:, bare] if there is None else np.where(there[:, bare], far[:, bare], np.nan)
            last[bare] = np.partition(near, self.k - 1, axis=0)[self.k - 1]
        near = ~(far > last + 2e-9)  # what ties to nine digits is near, and so is NaN
        j, i = np.nonzero(near if there is None else near & there)
        if len(i):
            self._keep(i + a, ids[j], _nine(far[j, i]))


def _nine(x: np.ndarray) -> np.ndarray:
    """x to nine digits, halves of its shortest decimal away from zero, as round() of Spark; from 2^23 on doubles are farther apart."""
    with np.errstate(all="ignore"):
        y = x * 1e9
        out = np.where(np.abs(x) < 1 << 23, np.rint(y) / 1e9, x)
        half = np.flatnonzero((np.abs(x) < 1 << 23) & (np.abs(np.abs(y - np.floor(y)) - 0.5) <= 1e-6 + np.abs(y) * 1e-15))
    for i in half:
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("1e-9"), ROUND_HALF_UP))
    return out
