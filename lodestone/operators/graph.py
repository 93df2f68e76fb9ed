"""Proximity graphs: adjacency, pruning, search, building and upkeep.

Tables: vectors (id, vec), edges (src, dst, dist), tombstones (id). Distances
are squared; pruning compares alpha times one of them with another.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import l2sq, mips_base, mips_query, norm
from lodestone.operators.knn import dimension, knn, top
from lodestone.operators.snapshot import EpochTaken, discard, materialize, read_epoch, write_epoch

R, ALPHA, BEAM, START_CAP = 8, 1.2, 10, 600
GRAPH_BYTES = 256 << 20  # a graph up to this size is sent to the search tasks; larger ones are searched by joins


# ---- adjacency


def knn_graph(vectors: DataFrame, r: int = R, dim: int | None = None) -> DataFrame:
    """src, dst, dist, rk: the r nearest others of every vector, exactly."""
    as_queries = vectors.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    near = knn(as_queries, vectors, r + 1, dim=dim).where("qid <> id")
    return top(near.select(F.col("qid").alias("src"), F.col("id").alias("dst"), "dist"), "src", r, "dist", "dst")


def adjacency(edges: DataFrame) -> DataFrame:
    """id, nbrs: partners in order of their number."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("nbrs"))


def out_degree(vectors: DataFrame, edges: DataFrame) -> DataFrame:
    counts = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    return vectors.select("id").join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("bigint").alias("degree"))


def in_degree(vectors: DataFrame, edges: DataFrame) -> DataFrame:
    counts = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    return vectors.select("id").join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("bigint").alias("degree"))


def reverse(edges: DataFrame, cap: int | None = None) -> DataFrame:
    """id, srcs: the sources of a node's edges by number; with cap the first cap of them, which are found before lists are made."""
    pairs = edges.select(F.col("dst").alias("id"), "src")
    pairs = pairs if cap is None else top(pairs, "id", cap, "src")
    return pairs.groupBy("id").agg(F.array_sort(F.collect_list("src")).alias("srcs"))


def validate(vectors: DataFrame, edges: DataFrame, r: int = R) -> DataFrame:
    """One row: nodes, edges, nodes of too many edges, loops, and edges to nodes that are not there."""
    nodes = vectors.agg(F.count("*").alias("n_nodes"))
    over = edges.groupBy("src").count().agg(F.count_if(F.col("count") > r).alias("n_over"))
    sums = edges.agg(F.count("*").alias("n_edges"), F.count_if(F.col("src") == F.col("dst")).alias("n_loops"))
    lost = edges.join(vectors.select(F.col("id").alias("dst")), "dst", "left_anti").agg(F.count("*").alias("n_lost"))
    return nodes.crossJoin(sums).crossJoin(over).crossJoin(lost)  # four single rows


def two_hop(edges: DataFrame) -> DataFrame:
    """src, dst: nodes two steps away that are neither the source nor its partners."""
    b = edges.select(F.col("src").alias("mid"), F.col("dst").alias("far"))
    far = edges.select("src", F.col("dst").alias("mid")).join(b, "mid").where("src <> far").select("src", F.col("far").alias("dst")).distinct()
    return far.join(edges.select("src", "dst"), ["src", "dst"], "left_anti")


def affected(edges: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Live nodes with an edge to a deleted one."""
    hit = edges.join(tombstones.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    return hit.join(tombstones, "id", "left_anti")


def reach(edges: DataFrame, start: int, steps: int | None = None) -> DataFrame:
    """id, depth: nodes that a breadth-first walk from start meets, in at most so many steps where a bound is asked for."""
    spark = edges.sparkSession
    seen = spark.createDataFrame([(start, 0)], "id bigint, depth int")
    pairs = materialize(edges.select("src", "dst"))
    for depth in count(1) if steps is None else range(1, steps + 1):
        front = seen.where(F.col("depth") == depth - 1).select(F.col("id").alias("src"))
        new = materialize(pairs.join(front, "src").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            break
        seen = materialize(seen.unionAll(new)) if depth % 16 == 0 else seen.unionAll(new)
    return seen


def medoid(vectors: DataFrame, dim: int | None = None) -> int:
    """The vector of least summed squared distance to all, which is the one nearest to their mean; the lower id on ties."""
    dim = dim or dimension(vectors)
    mean = vectors.agg(F.array(*(F.avg(F.get("vec", F.lit(i))) for i in range(dim))).alias("mean"))
    far = vectors.crossJoin(F.broadcast(mean)).select("id", F.round(l2sq(F.col("vec"), F.col("mean"), dim), 12).alias("dist"))  # one row
    return far.orderBy("dist", "id").first()["id"]


# ---- pruning


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, summed from left to right as the Column expressions do."""
    d = a - b
    return np.cumsum(d * d, axis=-1)[..., -1]


KEPT = "src bigint, ord int, dst bigint, dist double"


def keep(batches, r: int, alpha: float):
    """Frames of the edges kept of candidates (src, dst, dist, vec of dst) that come in order of src, dist, dst; a repeated candidate counts once."""
    last, held, full, prev = None, [], False, None
    for rows in batches:
        out = []
        for src, dst, dist, vec in zip(rows["src"].to_numpy(), rows["dst"].to_numpy(), rows["dist"].to_numpy(), rows["vec"]):
            if src != last:
                last, held, full, prev = src, [], False, None
            if full or dst == prev:
                continue
            prev = dst
            if not held or not (alpha * _squares(np.stack(held), vec) <= dist).any():
                held.append(np.asarray(vec))
                out.append((src, len(held), dst, dist))
                full = len(held) >= r
        yield pd.DataFrame(out, columns=["src", "ord", "dst", "dist"])


def select(dist: np.ndarray, vecs: np.ndarray, r: int, alpha: float) -> list[int]:
    """Places of the candidates that are kept, of candidates in order of distance; as keep, for one source."""
    kept: list[int] = []
    left = np.ones(len(dist), bool)
    while len(kept) < r and left.any():
        i = int(np.argmax(left))
        kept.append(i)
        left &= alpha * _squares(vecs, vecs[i]) > dist
        left[: i + 1] = False
    return kept


def prune(candidates: DataFrame, vectors: DataFrame, r: int = 6, alpha: float = ALPHA) -> DataFrame:
    """src, ord, dst, dist of the edges kept of candidates (src, dst, dist).

    Candidates of a source stream by in order of distance; only those kept are
    held, so that a hub may have any number.
    """

    full = candidates.select("src", "dst", "dist").join(vectors.select(F.col("id").alias("dst"), "vec"), "dst")
    return full.select("src", "dst", "dist", "vec").repartition("src").sortWithinPartitions("src", "dist", "dst").mapInPandas(lambda batches: keep(batches, r, alpha), KEPT)


def reverse_candidates(edges: DataFrame, vectors: DataFrame, dim: int | None = None) -> DataFrame:
    """Edges and their reverses, each pair once, with distances."""
    both = edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    return with_distances(both, vectors, dim)


def with_distances(pairs: DataFrame, vectors: DataFrame, dim: int | None = None) -> DataFrame:
    """(src, dst) with the distance of their vectors."""
    dim = dim or dimension(vectors)
    a = vectors.select(F.col("id").alias("src"), F.col("vec").alias("va"))
    b = vectors.select(F.col("id").alias("dst"), F.col("vec").alias("vb"))
    return pairs.join(a, "src").join(b, "dst").select("src", "dst", l2sq(F.col("va"), F.col("vb"), dim).alias("dist"))


def neighbourhood(edges: DataFrame, vectors: DataFrame, cap: int = 32, dim: int | None = None) -> DataFrame:
    """Nearest cap of a node's partners and their partners, as candidates."""
    near = edges.select("src", "dst").unionAll(two_hop(edges)).distinct()
    return top(with_distances(near, vectors, dim), "src", cap, "dist", "dst")


# ---- tombstones as bitmaps


BUCKET = 8 * 4096  # ids of a bitmap, as Spark's bitmap functions cut them


def deleted_bitmap(tombstones: DataFrame) -> DataFrame:
    """bucket, bits: tombstones (id) as bitmaps of BUCKET ids, 4 KB each; repeated ids count once, null ones not at all."""
    rows = tombstones.where("id IS NOT NULL").select(F.bitmap_bucket_number("id").alias("bucket"), F.bitmap_bit_position("id").alias("place"))
    return rows.groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bits"))


def join_bitmaps(*bitmaps: DataFrame) -> DataFrame:
    """bucket, bits of what any of the bitmaps has."""
    return reduce(DataFrame.unionByName, bitmaps).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def in_bitmap(df: DataFrame, bitmaps: DataFrame, column: str = "deleted") -> DataFrame:
    """df (id) with whether its id is in the bitmaps."""
    place = F.bitmap_bit_position("id")
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    both = df.withColumn("bucket", F.bitmap_bucket_number("id")).join(bitmaps, "bucket", "left")
    return both.withColumn(column, F.coalesce(hit, F.lit(False))).drop("bucket", "bits")


def gone_among(ids: np.ndarray, tombstones: DataFrame | None) -> np.ndarray:
    """Whether each of ids (sorted) is deleted; what comes from the tasks are bitmaps."""
    gone = np.zeros(len(ids), bool)
    if tombstones is None or not len(ids):
        return gone
    bucket = np.where(ids > 0, 1 + (ids - 1) // BUCKET, -(-ids // BUCKET))
    for row in deleted_bitmap(tombstones.where(F.col("id").between(int(ids[0]), int(ids[-1])))).collect():  # 4 KB for 32,768 ids of the index
        at = np.flatnonzero(bucket == row["bucket"])
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), bitorder="little")
        gone[at] = bits[np.where(ids[at] > 0, (ids[at] - 1) % BUCKET, -ids[at] % BUCKET)] == 1
    return gone


# ---- search


def greedy_kernel(distance, nbrs: list[np.ndarray], ids: np.ndarray, start: int, beam: int, deleted: np.ndarray):
    """Best-first search: worklist and expanded nodes as (distance, id, place), and distances computed; distance answers an array of places."""
    work, seen, expanded, cost = [(float(distance(np.array([start]))[0]), int(ids[start]), start)], {start}, [], 1
    done: set[int] = set()
    while True:
        node = next((w for w in work if w[2] not in done), None)
        if node is None or len(expanded) >= START_CAP:
            return work, expanded, cost
        done.add(node[2])
        expanded.append(node)
        new = [n for n in np.asarray(nbrs[node[2]]).tolist() if n not in seen and not deleted[n]]
        seen.update(new)
        if new:
            cost += len(new)
            work = sorted(work + [(float(x), int(ids[n]), n) for x, n in zip(distance(np.array(new)), new)])[:beam]


def _lists(edges: DataFrame, ids: np.ndarray) -> list[np.ndarray]:
    """Places of each node's partners, by number and each once; edges from or to an id that is no node are left out."""
    table = edges.select("src", "dst").toArrow()
    src, dst = (table.column(c).to_numpy() for c in ("src", "dst"))
    a, b = (np.minimum(np.searchsorted(ids, x), max(len(ids) - 1, 0)) for x in (src, dst))
    there = (ids[a] == src) & (ids[b] == dst) if len(ids) else np.zeros(len(src), bool)
    a, b = np.unique(np.stack([a[there], b[there]]), axis=1)
    return np.split(b, np.searchsorted(a, np.arange(1, len(ids)))) if len(ids) else []


def one_each(vectors: DataFrame) -> DataFrame:
    """id, vec: the least vector of every id."""
    return vectors.groupBy("id").agg(F.min("vec").alias("vec"))


def fits(vectors: DataFrame, edges: DataFrame, width: int) -> bool:
    """Whether a graph of so many bytes a node, with the edges that there are, is within GRAPH_BYTES."""
    return vectors.count() * width + edges.count() * 24 <= GRAPH_BYTES


def greedy_search(queries: DataFrame, vectors: DataFrame, edges: DataFrame, start: int, beam: int = BEAM, k: int = 10, tombstones: DataFrame | None = None, over: str = "worklist") -> DataFrame:
    """qid, rk, id, dist, steps, evals: the k best of the worklist, or of the expanded nodes, of a best-first walk from start.

    The visited set is exact. Repeated edges count once, and of vectors of one id
    the least does. Deleted nodes are neither expanded nor reported,
    except that the walk may begin at one; edges to an id that is no vector lead
    nowhere, and where start is none nothing is found. The graph goes to the
    tasks whole while it is within GRAPH_BYTES; a larger one is walked by joins,
    a step of all queries at a time, with the same result.
    """
    spark = queries.sparkSession
    if not fits(vectors, edges, 8 * (dimension(vectors) or 1) + 8):
        return walk_by_joins(queries, vectors, edges, start, beam, k, tombstones, over)
    table = one_each(vectors).toPandas().sort_values("id")
    ids = table["id"].to_numpy().astype(np.int64)
    vecs = np.stack(table["vec"].to_numpy()) if len(ids) else np.zeros((0, 1))
    gone = gone_among(ids, tombstones)
    graph = spark.sparkContext.broadcast((ids, vecs, _lists(edges, ids), gone))

    def search(batches):
        ids, vecs, nbrs, gone = graph.value
        at = int(np.searchsorted(ids, start))
        for batch in batches:
            rows = []
            for qid, q in zip(batch["qid"], batch["qvec"]) if at < len(ids) and ids[at] == start else ():
                q = np.asarray(q)
                work, expanded, cost = greedy_kernel(lambda n, q=q: _squares(vecs[n], q), nbrs, ids, at, beam, gone)
                rows += _best(qid, work, expanded, cost, gone, k, over)
            yield pd.DataFrame(rows, columns=["qid", "rk", "id", "dist", "steps", "evals"])

    return queries.mapInPandas(search, FOUND)


def mips_tables(vectors: DataFrame, queries: DataFrame, digits: int = 9) -> tuple[DataFrame, DataFrame]:
    """vectors and queries with one element more, between which the nearest are those of largest inner product; build and search as with any others.

    Elements have so many digits, so that equal inputs give equal tables
    everywhere. Vectors are divided by the largest length of all of them.
    """
    dim = dimension(vectors)
    short = lambda u: F.transform(u, lambda x: F.round(x, digits) + F.lit(0.0))
    largest = vectors.agg(F.max(norm(F.col("vec"), dim)).alias("m"))
    base = vectors.crossJoin(F.broadcast(largest)).select("id", short(mips_base(F.col("vec"), F.col("m"), dim)).alias("vec"))  # one row
    return base, queries.select("qid", short(mips_query(F.col("qvec"), dim)).alias("qvec"))


FOUND = "qid bigint, rk int, id bigint, dist double, steps int, evals int"


def _best(qid: int, work: list, expanded: list, cost: int, gone: np.ndarray, k: int, over: str) -> list[tuple]:
    best = [w for w in (work if over == "worklist" else sorted(expanded)) if not gone[w[2]]][:k]
    return [(qid, i + 1, w[1], w[0], len(expanded), cost) for i, w in enumerate(best)]


def pq_search(queries: DataFrame, vectors: DataFrame, codes: DataFrame, table: DataFrame, edges: DataFrame, start: int, beam: int = BEAM, k: int = 10, tombstones: DataFrame | None = None) -> DataFrame:
    """qid, rk, id, dist: a best-first walk on approximate distances, whose expanded nodes are ranked by exact ones.

    codes (id, chunk, code) and table (qid, chunk, code, d2) as product
    quantisation makes them; a distance is the sum over the chunks, to nine
    digits. Tasks get codes, one byte or two for each chunk, and edges while they
    are within GRAPH_BYTES, and no vectors; beyond, the walk goes by joins.
    """
    spark = queries.sparkSession
    codes = codes.groupBy("id", "chunk").agg(F.min("code").alias("code"))  # repeated rows count once
    table = table.groupBy("qid", "chunk", "code").agg(F.min("d2").alias("d2"))
    queries = queries.groupBy("qid").agg(F.min("qvec").alias("qvec"))
    chunks = codes.agg(F.max("chunk")).first()[0]
    n_chunks = 0 if chunks is None else chunks + 1
    walked = queries.select("qid").distinct().join(_tables(table, n_chunks), "qid")
    if not n_chunks or not fits(codes.select("id").distinct(), edges, 2 * n_chunks + 8):
        return rerank_by_join(pq_walk_by_joins(queries, codes, table, edges, start, beam, tombstones), queries, vectors, k)
    rows = codes.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "code"))), lambda x: x["code"]).alias("c")).toPandas().sort_values("id")
    ids = rows["id"].to_numpy().astype(np.int64)
    gone = gone_among(ids, tombstones)
    graph = spark.sparkContext.broadcast((ids, np.stack(rows["c"].to_numpy()).astype(np.int16), _lists(edges, ids), gone))

    def search(batches):
        ids, codes, nbrs, gone = graph.value
        at, each = int(np.searchsorted(ids, start)), np.arange(n_chunks)
        for batch in batches:
            rows = []
            for qid, t in zip(batch["qid"], batch["t"]) if at < len(ids) and ids[at] == start else ():
                t = np.stack(t)
                _, expanded, _ = greedy_kernel(lambda n, t=t: np.round(np.cumsum(t[each, codes[n]], axis=1)[:, -1], 9), nbrs, ids, at, beam, gone)
                rows += [(qid, w[1]) for w in expanded if not gone[w[2]]]
            yield pd.DataFrame(rows, columns=["qid", "id"])

    return rerank_by_join(walked.mapInPandas(search, "qid bigint, id bigint"), queries, vectors, k)


def _tables(table: DataFrame, n_chunks: int) -> DataFrame:
    """qid, t: each query's distance table, one list for each chunk."""
    lists = table.groupBy("qid", "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("code", "d2"))), lambda x: x["d2"]).alias("l"))
    return lists.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "l"))), lambda x: x["l"]).alias("t"))


def rerank_by_join(found: DataFrame, queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The k of found (qid, id) that are nearest by exact distance."""
    from lodestone.operators.knn import rerank

    return rerank(found, queries, vectors, k)


def pq_walk_by_joins(queries: DataFrame, codes: DataFrame, table: DataFrame, edges: DataFrame, start: int, beam: int = BEAM, tombstones: DataFrame | None = None, steps: int = START_CAP) -> DataFrame:
    """qid, id of the nodes that a walk on approximate distances expands, by joins."""

    def measured(pairs: DataFrame) -> DataFrame:
        near = pairs.join(codes, "id").join(table, ["qid", "chunk", "code"])
        return near.groupBy("qid", "id").agg(F.round(F.aggregate(F.array_sort(F.collect_list(F.struct("chunk", "d2"))), F.lit(0.0), lambda s, x: s + x["d2"]), 9).alias("dist"))

    state = _walk(queries.select("qid"), measured, edges, start, beam, tombstones, steps)
    pool = state.where("step > 0").select("qid", "id")
    return pool if tombstones is None else pool.join(tombstones, "id", "left_anti")


def dual_search(queries: DataFrame, static: DataFrame, edges: DataFrame, fresh: DataFrame, start: int, beam: int = BEAM, k: int = 10, tombstones: DataFrame | None = None) -> DataFrame:
    """qid, rk, id, segment, dist: the k best of a walk over the static segment's graph and of the fresh segment as a whole."""
    walked = greedy_search(queries, static, edges, start, beam, k, tombstones, over="worklist").select("qid", "id", "dist", F.lit("static").alias("segment"))
    near = knn(queries, fresh, k, tombstones).select("qid", "id", "dist", F.lit("fresh").alias("segment"))
    return top(walked.unionAll(near), "qid", k).select("qid", "rk", "id", "segment", "dist")


def _walk(queries: DataFrame, measured, edges: DataFrame, start: int, beam: int, tombstones: DataFrame | None, steps: int) -> DataFrame:
    """qid, id, dist, step (0 if not expanded), listed: every node that a walk met; every step expands one node of every query that has one left.

    measured gives pairs (qid, id) their dist, and leaves out ids that are no node.
    """
    live = edges.select("src", "dst").join(tombstones.select(F.col("id").alias("dst")), "dst", "left_anti") if tombstones is not None else edges.select("src", "dst")
    fresh = lambda df: df.select("qid", "id", "dist", F.lit(0).alias("step"), F.lit(True).alias("listed"))
    by = Window.partitionBy("qid").orderBy("dist", "id")
    state = materialize(fresh(measured(queries.select("qid", F.lit(start).cast("bigint").alias("id")))))
    for step in range(1, steps + 1):
        front = top(state.where("listed AND step = 0"), "qid", 1).select("qid", F.col("id").alias("src"))
        if front.isEmpty():
            break
        new = front.join(live, "src").select("qid", F.col("dst").alias("id")).distinct().join(state, ["qid", "id"], "left_anti")
        done = state.join(front.withColumnRenamed("src", "id").withColumn("now", F.lit(step)), ["qid", "id"], "left").withColumn("step", F.coalesce("now", "step")).drop("now")
        every = done.select("qid", "id", "dist", "step", "listed").unionAll(fresh(measured(new)))
        rank = F.sum(F.col("listed").cast("int")).over(by)
        before, state = state, materialize(every.withColumn("listed", F.col("listed") & (rank <= beam)))
        discard(before)
    return state


def walk_by_joins(queries: DataFrame, vectors: DataFrame, edges: DataFrame, start: int, beam: int = BEAM, k: int = 10, tombstones: DataFrame | None = None, over: str = "worklist", steps: int = START_CAP) -> DataFrame:
    """As greedy_search, by joins."""
    dim = dimension(vectors)
    vectors = materialize(one_each(vectors))

    def measured(pairs: DataFrame) -> DataFrame:
        return pairs.join(vectors.select("id", "vec"), "id").join(queries, "qid").select("qid", "id", l2sq(F.col("qvec"), F.col("vec"), dim).alias("dist"))

    state = _walk(queries, measured, edges, start, beam, tombstones, steps)
    pool = state.where("listed" if over == "worklist" else "step > 0")
    if tombstones is not None:
        pool = pool.join(tombstones, "id", "left_anti")
    cost = state.groupBy("qid").agg(F.count_if(F.expr("step > 0")).cast("int").alias("steps"), F.count("*").cast("int").alias("evals"))
    return top(pool, "qid", k).join(cost, "qid").select("qid", "rk", "id", "dist", "steps", "evals")


# ---- building and upkeep


FIRST = 128  # vectors of the first batch of a graph that is built from nothing, at least


def build(vectors: DataFrame, start: int | None = None, r: int = 6, alpha: float = ALPHA, beam: int = 24, passes: int = 1, base: DataFrame | None = None, first: int = FIRST, order: Column | None = None) -> DataFrame:
    """src, ord, dst, dist: a graph over vectors.

    From base, or from what grow makes of the vectors, by passes: search for
    every node from start (or the medoid), prune what was expanded, then add and
    prune reverse edges.
    """
    vectors = one_each(vectors) if base is None else vectors
    edges = base if base is not None else grow(vectors, r, alpha, beam, first, order)
    as_queries = vectors.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    passes = 0 if vectors.isEmpty() else passes
    start = medoid(vectors) if start is None and passes else start
    for _ in range(passes):
        found = greedy_search(as_queries, vectors, edges, start, beam, START_CAP, over="expanded").where("qid <> id")
        candidates = found.select(F.col("qid").alias("src"), F.col("id").alias("dst")).unionAll(edges.select("src", "dst")).distinct()
        pruned = materialize(prune(with_distances(candidates, vectors), vectors, r, alpha))
        edges = materialize(prune(reverse_candidates(pruned, vectors), vectors, r, alpha))
    return edges


def grow(vectors: DataFrame, r: int = 6, alpha: float = ALPHA, beam: int = 24, first: int = FIRST, order: Column | None = None) -> DataFrame:
    """src, ord, dst, dist: a graph from nothing, in batches that double.

    The first batch, of first to twice as many vectors, is compared with itself;
    each further one, as large as all before it, is searched for in the graph so
    far, pruned and linked back. Batches go by order modulo a power of two (by a
    hash of the id where none is given), so that each is spread over all vectors.
    No more than the first batch ever meets itself, and rounds are as many as the
    logarithm of the vectors.
    """
    vectors = materialize(vectors.select("id", "vec"))
    rounds = max(0, (max(vectors.count(), 1) // first).bit_length() - 1)
    place = F.pmod(F.xxhash64("id") if order is None else order, F.lit(1 << rounds))
    batch = vectors.withColumn("_batch", F.when(place == 0, 0).otherwise(F.length(F.bin(place))))
    so_far = batch.where("_batch = 0").drop("_batch")
    edges = materialize(prune(knn_graph(so_far, 32), so_far, r, alpha))
    if so_far.isEmpty():
        return edges
    start = medoid(so_far)
    for i in range(1, rounds + 1):
        before, edges = edges, insert(so_far, edges, batch.where(F.col("_batch") == i).drop("_batch"), start, r, alpha, beam)
        discard(before)
        so_far = batch.where(F.col("_batch") <= i).drop("_batch")
    return edges


def insert(vectors: DataFrame, edges: DataFrame, new: DataFrame, start: int, r: int = 6, alpha: float = ALPHA, beam: int = 24, tombstones: DataFrame | None = None) -> DataFrame:
    """Edges after new vectors are written, searched for, pruned, and linked back; all are written before any is searched for.

    A new vector of an id that is there takes its place: the old one's edges, from
    it and to it, go, and it is found by nothing any more, though a walk may
    begin at it. Deleted nodes are not linked to.
    """
    new = one_each(new)
    moved = new.select("id")
    everything = vectors.select("id", "vec").join(moved, "id", "left_anti").unionAll(new)
    gone = moved if tombstones is None else moved.union(tombstones.select("id"))
    found = greedy_search(new.select(F.col("id").alias("qid"), F.col("vec").alias("qvec")), vectors, edges, start, beam, START_CAP, gone, over="expanded")
    out = materialize(prune(found.select(F.col("qid").alias("src"), F.col("id").alias("dst"), "dist"), everything, r, alpha))
    back = out.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    touched = back.select("src").distinct()
    kept = edges.join(moved.select(F.col("id").alias("src")), "src", "left_anti").join(moved.select(F.col("id").alias("dst")), "dst", "left_anti")
    redo = kept.select("src", "dst").join(touched, "src", "left_semi").unionAll(back).distinct()
    same = kept.select("src", "ord", "dst", "dist").join(touched, "src", "left_anti")
    return materialize(same.unionAll(out).unionAll(prune(with_distances(redo, everything), everything, r, alpha)))


def reinsert(vectors: DataFrame, edges: DataFrame, tombstones: DataFrame, ids: DataFrame, start: int, **how) -> tuple[DataFrame, DataFrame]:
    """Edges and tombstones after deleted nodes come back; ids that are not deleted are left alone."""
    back = ids.join(tombstones, "id", "left_semi")
    live = vectors.join(tombstones, "id", "left_anti")
    kept = edges.join(back.select(F.col("id").alias("src")), "src", "left_anti").join(tombstones.select(F.col("id").alias("dst")), "dst", "left_anti")
    return insert(live, kept, vectors.join(back, "id", "left_semi"), start, **how), tombstones.join(back, "id", "left_anti")


def repair_candidates(edges: DataFrame, vectors: DataFrame, tombstones: DataFrame, r: int = 6, dim: int | None = None) -> DataFrame:
    """For live nodes with deleted partners: live partners and, through these, live second ones; the 4 r nearest."""
    gone = tombstones.select(F.col("id").alias("dst"))
    live = edges.select("src", "dst").join(gone, "dst", "left_anti").join(tombstones.select(F.col("id").alias("src")), "src", "left_anti")
    hit = affected(edges, tombstones).select(F.col("id").alias("src"))
    near = live.join(hit, "src", "left_semi")
    far = near.select("src", F.col("dst").alias("mid")).join(live.select(F.col("src").alias("mid"), "dst"), "mid").where("src <> dst").select("src", "dst")
    return top(with_distances(near.unionAll(far).distinct(), vectors, dim), "src", 4 * r, "dist", "dst")


def consolidate(edges: DataFrame, vectors: DataFrame, tombstones: DataFrame, r: int = 6, alpha: float = ALPHA) -> DataFrame:
    """Edges of the next epoch: deleted nodes and their edges are gone, nodes that had such edges are pruned anew.

    A repaired node with fewer than r candidates also takes those that a search
    of the live graph from its medoid finds, up to 2 r.
    """
    live = vectors.join(tombstones, "id", "left_anti")
    hit = materialize(affected(edges, tombstones).select(F.col("id").alias("src")))
    candidates = materialize(repair_candidates(edges, vectors, tombstones, r).select("src", "dst", "dist"))
    few = hit.join(candidates.groupBy("src").count(), "src", "left").where(F.coalesce("count", F.lit(0)) < r).select("src")
    asked = materialize(few.join(vectors.select(F.col("id").alias("src"), "vec"), "src").select(F.col("src").alias("qid"), F.col("vec").alias("qvec")))
    if not asked.isEmpty():
        extra = greedy_search(asked, live, edges, medoid(live), 4 * r, 2 * r + 1, tombstones).where("qid <> id")
        candidates = candidates.unionAll(extra.select(F.col("qid").alias("src"), F.col("id").alias("dst"), "dist")).dropDuplicates(["src", "dst"])
    fixed = prune(candidates, vectors, r, alpha)
    kept = edges.join(hit, "src", "left_anti").join(tombstones.select(F.col("id").alias("src")), "src", "left_anti")
    return materialize(kept.select("src", "ord", "dst", "dist").unionAll(fixed))


# ---- epochs: an index as the tables vectors, edges and tombstones of each epoch under a folder


def search_epoch(spark: SparkSession, root: str, queries: DataFrame, start: int, beam: int = BEAM, k: int = 10, over: str = "worklist", epoch: int | None = None) -> DataFrame:
    """greedy_search over the given epoch of the index under root, or the last whole one; epochs written meanwhile are not seen."""
    _, t = read_epoch(spark, root, epoch)
    return greedy_search(queries, t["vectors"], t["edges"], start, beam, k, t["tombstones"], over)


def insert_epoch(spark: SparkSession, root: str, new: DataFrame, start: int, attempts: int = 20, **how) -> int:
    """Insert new vectors (id, vec) into the last whole epoch and commit the next; returns its number.

    An id that is there gets its new vector, a deleted one comes back with it.
    Where another writer has committed meanwhile, the work is done again upon its
    epoch, at most so many times.
    """
    for _ in range(attempts):
        epoch, t = read_epoch(spark, root)
        edges = insert(t["vectors"], t["edges"], new, start, tombstones=t["tombstones"], **how)
        ids = new.select("id")
        vectors = t["vectors"].select("id", "vec").join(ids, "id", "left_anti").unionByName(one_each(new))
        try:
            write_epoch(root, epoch + 1, vectors=vectors, edges=edges, tombstones=t["tombstones"].join(ids, "id", "left_anti"))
            return epoch + 1
        except EpochTaken:
            continue
    raise EpochTaken(f"other writers were faster {attempts} times")


def delete_epoch(spark: SparkSession, root: str, ids: DataFrame, attempts: int = 20) -> int:
    """Mark ids (id) of the last whole epoch as deleted and commit the next, as insert_epoch does; ids that are not there are left out."""
    for _ in range(attempts):
        epoch, t = read_epoch(spark, root)
        tombstones = t["tombstones"].select("id").union(ids.select("id").join(t["vectors"], "id", "left_semi")).distinct()
        try:
            write_epoch(root, epoch + 1, vectors=t["vectors"], edges=t["edges"], tombstones=tombstones)
            return epoch + 1
        except EpochTaken:
            continue
    raise EpochTaken(f"other writers were faster {attempts} times")


def consolidate_epoch(spark: SparkSession, root: str, epoch: int | None = None, attempts: int = 20, **how) -> tuple[int, int]:
    """Consolidate the given epoch, or the last, and commit it as the one after the last; returns its number and how many vectors left.

    Epochs that others commit meanwhile are kept: nodes that came, came back or
    have another vector since, and those that were linked to them, have their
    edges of the last epoch, and what was deleted since stays deleted. What is
    consolidated once is laid upon whatever epoch is the last when it is
    committed, again where another writer was faster.
    """
    _, then = read_epoch(spark, root, epoch)
    edges = consolidate(then["edges"], then["vectors"], then["tombstones"], **how)
    for _ in range(attempts):
        last, now = read_epoch(spark, root)
        gone = then["tombstones"].join(now["tombstones"], "id", "left_semi")
        came = now["vectors"].select("id", "vec").join(then["vectors"].select("id", "vec"), ["id", "vec"], "left_anti").select("id").unionByName(then["tombstones"].join(now["tombstones"], "id", "left_anti"))
        linked = now["edges"].join(came.select(F.col("id").alias("dst")), "dst", "left_semi").select("src")
        touched = materialize(came.select(F.col("id").alias("src")).union(linked).distinct())
        out = gone.select(F.col("id").alias("src")), gone.select(F.col("id").alias("dst"))
        late = now["edges"].join(touched, "src", "left_semi").join(out[0], "src", "left_anti").join(out[1], "dst", "left_anti").select("src", "ord", "dst", "dist")
        same = edges.join(touched, "src", "left_anti").join(came.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "ord", "dst", "dist")
        try:
            write_epoch(root, last + 1, vectors=now["vectors"].join(gone, "id", "left_anti"), edges=same.unionByName(late), tombstones=now["tombstones"].join(gone, "id", "left_anti"))
        except EpochTaken:
            continue
        return last + 1, gone.join(now["vectors"], "id", "left_semi").count()
    raise EpochTaken(f"other writers were faster {attempts} times")
