"""Operators on small fixtures: search, upkeep, streams, files."""

from __future__ import annotations

import dataclasses
import json
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import functions as fn
from lodestone import sources
from lodestone.operators import events as ev
from lodestone.operators import graph, knn, metrics, snapshot
from lodestone.streaming import Index, counts, replay

DIM = 8


def vectors(spark, n, seed=1, first=0):
    rng = random.Random(seed)
    return spark.createDataFrame([(first + i, [rng.gauss(0, 1) for _ in range(DIM)]) for i in range(n)], "id long, vec array<double>")


@pytest.fixture(scope="module")
def v(spark):
    return snapshot.materialize(vectors(spark, 300))


@pytest.fixture(scope="module")
def q(spark):
    return snapshot.materialize(vectors(spark, 12, 2).withColumnsRenamed({"id": "qid", "vec": "qvec"}))


@pytest.fixture(scope="module")
def edges(v):
    return snapshot.materialize(graph.build(v, 0, beam=16))


def ids(df, column="id"):
    return {r[column] for r in df.collect()}


def test_functions_agree_with_numpy_and_their_sql_twins(spark):
    fn.register(spark)
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(20, DIM)), rng.normal(size=(20, DIM))
    df = spark.createDataFrame([(x.tolist(), y.tolist()) for x, y in zip(a, b)], "a array<double>, b array<double>")
    x, y = F.col("a"), F.col("b")
    cols = {"d": fn.l2sq(x, y, DIM), "dh": fn.l2sq(x, y), "ds": F.expr("l2sq(a, b)"), "p": fn.dot(x, y, DIM), "ps": F.expr("dot(a, b)"), "c": fn.cosine(x, y, DIM), "n": fn.norm(x), "u": fn.normalize(x, DIM), "us": F.expr("vnormalize(a)")}
    for r, s, t in zip(df.select(*(c.alias(k) for k, c in cols.items())).collect(), a, b):
        assert r["d"] == r["dh"] == r["ds"] and r["p"] == r["ps"] and r["u"] == r["us"]
        assert math.isclose(r["d"], ((s - t) ** 2).sum()) and math.isclose(r["c"], s @ t / np.linalg.norm(s) / np.linalg.norm(t)) and math.isclose(r["n"], np.linalg.norm(s))
    zero = spark.createDataFrame([([0.0, 0.0],)], "a array<double>")
    assert zero.select(fn.normalize(F.col("a"))).first()[0] == [0.0, 0.0]


def test_queries_beyond_the_broadcast_bound_give_the_same(v, q, monkeypatch):
    want = sorted(map(tuple, knn.knn(q, v).collect()))
    monkeypatch.setattr(knn, "QUERY_BYTES", 300)
    assert len(knn.blocks(q)) > 1
    assert sorted(map(tuple, knn.knn(q, v).collect())) == want


def test_mips_reduction_orders_by_inner_product(v, q):
    largest = v.agg(F.max(fn.norm(F.col("vec"), DIM)).alias("m"))
    pairs = v.crossJoin(largest).crossJoin(q)
    d = fn.l2sq(fn.mips_query(F.col("qvec"), DIM), fn.mips_base(F.col("vec"), F.col("m"), DIM))
    rows = pairs.select("qid", "id", d.alias("d"), fn.dot(F.col("qvec"), F.col("vec"), DIM).alias("p")).collect()
    for qid in {r["qid"] for r in rows}:
        mine = [r for r in rows if r["qid"] == qid]
        assert [r["id"] for r in sorted(mine, key=lambda r: r["d"])[:10]] == [r["id"] for r in sorted(mine, key=lambda r: -r["p"])[:10]]


def test_pruning_keeps_fewer_as_alpha_falls_below(v):
    near = graph.knn_graph(v, 24, DIM)
    mean = lambda a: graph.prune(near, v, 6, a).groupBy("src").count().agg({"count": "avg"}).first()[0]
    assert mean(1.0) <= mean(1.2) + 1e-9


def test_search_recall_and_both_walks(v, q, edges):
    truth = knn.knn(q, v, 10)
    found = snapshot.materialize(graph.greedy_search(q, v, edges, 0, 40, 10))
    assert metrics.recall(truth, found).first()["recall"] >= 90
    by_joins = graph.walk_by_joins(q.where("qid < 3"), v, edges, 0, 6, 5)
    kernel = graph.greedy_search(q.where("qid < 3"), v, edges, 0, 6, 5)
    assert sorted(map(tuple, by_joins.collect())) == sorted(map(tuple, kernel.collect()))


def test_search_with_deletes_never_reports_them(spark, v, q, edges):
    dead = v.where("id % 4 = 1").select("id")
    for over in ("worklist", "expanded"):
        found = graph.greedy_search(q, v, edges, 1, 20, 10, dead, over)
        assert not ids(found) & ids(dead)
    rows = graph.greedy_search(q, v, edges, 0, 20, 10).collect()
    for qid in {r["qid"] for r in rows}:
        mine = sorted((r for r in rows if r["qid"] == qid), key=lambda r: r["rk"])
        assert len({r["id"] for r in mine}) == len(mine) and [r["dist"] for r in mine] == sorted(r["dist"] for r in mine)


def test_insert_then_search_finds_it_first(spark, v, edges):
    new = snapshot.materialize(vectors(spark, 10, 9, 1000))
    after = graph.insert(v, edges, new, 0)
    asked = new.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    best = graph.greedy_search(asked, v.unionAll(new), after, 0, 40, 1).collect()
    assert sum(r["qid"] == r["id"] for r in best) >= 9
    assert after.groupBy("src").count().agg({"count": "max"}).first()[0] <= 6


def test_consolidation_drops_deleted_nodes_for_good(spark, v, q, edges):
    dead = v.where("id % 5 = 2").select("id")
    after = graph.consolidate(edges, v, dead)
    assert not (ids(after, "src") | ids(after, "dst")) & ids(dead)
    live = v.join(dead, "id", "left_anti")
    assert not ids(graph.greedy_search(q, live, after, 0, 40, 10)) & ids(dead)
    truth, found = knn.knn(q, live, 10), graph.greedy_search(q, live, after, 0, 40, 10)
    assert metrics.recall(truth, found).first()["recall"] >= 85
    nothing = dead.limit(0)
    assert sorted(map(tuple, graph.consolidate(edges, v, nothing).collect())) == sorted(map(tuple, edges.select("src", "ord", "dst", "dist").collect()))


def test_reinsert_takes_back_only_what_is_deleted(v, edges):
    dead = v.where("id IN (5, 6, 7)").select("id")
    after, left = graph.reinsert(v, edges, dead, v.where("id IN (6, 100)").select("id"), 0)
    assert ids(left) == {5, 7} and 6 in ids(after, "src")


def test_trained_pivots_rank_well(v, q):
    pivots = snapshot.materialize(knn.train_pivots(v, 16, 4, 2))
    near = knn.top(knn.adc(knn.encode(v, pivots, 4, 2), knn.distance_table(q, pivots, 4, 2)), "qid", 40)
    assert metrics.recall(knn.knn(q, v, 10), knn.rerank(near, q, v)).first()["recall"] >= 90


def test_epochs(spark, v, tmp_path):
    root = f"file://{tmp_path}/index"
    snapshot.write_epoch(root, 0, vectors=v, tombstones=v.limit(0).select("id"))
    snapshot.write_epoch(root, 1, vectors=v.where("id > 5"), tombstones=v.limit(0).select("id"))
    assert snapshot.read_epoch(spark, root)[0] == 1
    assert snapshot.read_epoch(spark, root, 0)[1]["vectors"].count() == 300


def test_epochs_committed_during_a_consolidation_are_kept(spark, v, q, edges, tmp_path):
    root = f"file://{tmp_path}/index"
    dead, later, back = v.where("id % 5 = 2").select("id"), v.where("id IN (11, 21)").select("id"), {7, 12}
    snapshot.write_epoch(root, 1, vectors=v, edges=edges, tombstones=dead)
    before = sorted(map(tuple, graph.search_epoch(spark, root, q, 0).collect()))
    new = snapshot.materialize(vectors(spark, 10, 9, 1000))
    assert graph.insert_epoch(spark, root, new, 0) == 2
    _, t = snapshot.read_epoch(spark, root)
    again, left = graph.reinsert(t["vectors"], t["edges"], dead, dead.where("id IN (7, 12)"), 0)
    snapshot.write_epoch(root, 3, vectors=t["vectors"], edges=again, tombstones=left.unionByName(later))
    assert sorted(map(tuple, graph.search_epoch(spark, root, q, 0, epoch=1).collect())) == before
    assert graph.consolidate_epoch(spark, root, 1) == (4, 58)
    number, t = snapshot.read_epoch(spark, root)
    gone = ids(dead) - back
    assert number == 4 and ids(t["tombstones"]) == {11, 21} and ids(t["vectors"]) == (ids(v) | ids(new)) - gone
    check = graph.validate(t["vectors"], t["edges"], 6).first()
    assert (check["n_over"], check["n_loops"], check["n_lost"]) == (0, 0, 0) and not ids(t["edges"], "src") & gone
    asked = t["vectors"].where("id >= 1000 OR id IN (7, 12)").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    best = graph.search_epoch(spark, root, asked, 0, 40, 1).collect()
    assert len(best) == 12 and sum(r["qid"] == r["id"] for r in best) >= 11


def test_edges_to_nothing_lead_nowhere(spark, v, q, edges, monkeypatch):
    holes = v.where("id % 4 <> 1")
    odd = edges.unionByName(edges.limit(3).withColumn("dst", F.lit(-5).cast("bigint"))).unionByName(edges.limit(3).withColumn("src", F.lit(10_000).cast("bigint")))
    start = holes.agg(F.min("id")).first()[0]
    at_once = graph.greedy_search(q, holes, odd, start, 12, 5).collect()
    monkeypatch.setattr(graph, "GRAPH_BYTES", 0)
    by_joins = graph.greedy_search(q, holes, odd, start, 12, 5).collect()
    assert sorted(map(tuple, at_once)) == sorted(map(tuple, by_joins)) and len(at_once)
    assert all(r["id"] % 4 != 1 for r in at_once)
    assert graph.greedy_search(q, holes, odd, 10_000, 12, 5).count() == 0
    monkeypatch.undo()
    assert graph.greedy_search(q, holes, odd, 10_000, 12, 5).count() == 0


def test_pq_walks_agree_and_find_what_is_near(spark, v, q, edges, monkeypatch):
    pivots = snapshot.materialize(knn.refine_pivots(v, knn.pivots(v, 64, 4, 2), 3, 4, 2))
    codes, table = snapshot.materialize(knn.encode(v, pivots, 4, 2)), knn.distance_table(q, pivots, 4, 2)
    dead = v.where("id % 9 = 4").select("id")
    how = (edges, 0, 40, 10, dead)
    at_once = graph.pq_search(q, v, codes, table, *how)
    assert metrics.recall(knn.knn(q, v, 10, dead), at_once).first()["recall"] >= 85
    want = sorted(map(tuple, at_once.collect()))
    monkeypatch.setattr(graph, "GRAPH_BYTES", 0)
    assert sorted(map(tuple, graph.pq_search(q, v, codes, table, *how).collect())) == want
    assert not {r[2] for r in want} & ids(dead)


def test_refined_pivots_lose_less(v):
    rough = knn.pivots(v, 16, 4, 2)
    parts = knn.chunks(v.select("id", "vec"), "vec", 4, 2)

    def loss(pivots):
        both = knn.encode(v, pivots, 4, 2).join(pivots, ["chunk", "code"]).join(parts, ["id", "chunk"])
        return both.agg(F.sum(fn.l2sq(F.col("part"), F.col("sub"), 2))).first()[0]

    assert loss(knn.refine_pivots(v, rough, 3, 4, 2)) < 0.9 * loss(rough)


def test_dual_search_finds_in_both_segments(spark, v, q, edges):
    static, fresh, dead = v.where("id % 5 <> 4"), v.where("id % 5 = 4").select("id", "vec"), v.where("id % 9 = 4").select("id")
    mine = graph.prune(graph.knn_graph(static, 24), static, 8)
    got = graph.dual_search(q, static, mine, fresh, 0, 40, 10, dead)
    assert metrics.recall(knn.knn(q, v, 10, dead), got).first()["recall"] >= 90
    assert {(r["segment"] == "fresh") == (r["id"] % 5 == 4) for r in got.collect()} == {True}


def test_reverse_edges_of_a_hub(spark):
    edges = spark.range(1, 1200).selectExpr("id AS src", "0L AS dst")
    assert len(graph.reverse(edges).first()["srcs"]) == 1199
    assert graph.reverse(edges, 500).first()["srcs"] == list(range(1, 501))


def test_pruning_of_a_hub_matches_the_plain_fold(spark, v):
    vec = {r["id"]: np.array(r["vec"]) for r in v.collect()}
    pairs = graph.with_distances(v.where("id > 0").select(F.lit(0).cast("bigint").alias("src"), F.col("id").alias("dst")), v)
    kept = []
    for r in sorted(pairs.collect(), key=lambda r: (r["dist"], r["dst"])):
        if len(kept) < 7 and not any(1.2 * ((vec[k] - vec[r["dst"]]) ** 2).cumsum()[-1] <= r["dist"] for k in kept):
            kept.append(r["dst"])
    assert [r["dst"] for r in graph.prune(pairs, v, 7).orderBy("ord").collect()] == kept


def test_the_medoid_is_nearest_to_all(v):
    vec = {r["id"]: np.array(r["vec"]) for r in v.collect()}
    assert graph.medoid(v) == min(vec, key=lambda i: (round(sum(((vec[i] - x) ** 2).sum() for x in vec.values()), 6), i))


def test_rows_are_numbered_over_ranges(spark):
    rows = spark.range(1000).selectExpr("(id * 7919) % 1000 AS x")
    got = snapshot.numbered(rows.repartition(5), "x").collect()
    assert sorted((r["x"], r["seq"]) for r in got) == [(i, i + 1) for i in range(1000)]


def test_no_shared_folder_is_an_error_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = type("Conf", (), {"get": staticmethod(lambda *a: None)})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        snapshot.shared_dir(Session)


# ---- files


def test_vector_files_come_back(spark, v, tmp_path):
    for layout in ("vecs", "bin"):
        path = tmp_path / f"x.{layout}"
        assert sources.write_vectors(v, str(path), layout) == 300
        back = sources.read_vectors(spark, f"file://{path}", layout)
        want = {r["id"]: np.float32(r["vec"]).tolist() for r in v.collect()}
        assert {r["id"]: r["vec"] for r in back.collect()} == want
    assert sources.read_vectors(spark, f"file://{tmp_path}/x.vecs", multiple=5, limit=3).select(F.size("vec")).collect() == [(10,)] * 3


def test_large_files_are_split_and_give_the_same(spark, v, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/x.vecs"
    sources.write_vectors(v, path)
    whole = {r["id"]: r["vec"] for r in sources.read_vectors(spark, path, multiple=5).collect()}
    monkeypatch.setattr(sources, "WHOLE", 2000)
    df = sources.read_vectors(spark, path, multiple=5)
    assert df.rdd.getNumPartitions() > 4
    assert {r["id"]: r["vec"] for r in df.collect()} == whole
    assert sorted(r["id"] for r in sources.read_vectors(spark, path, limit=70).collect()) == list(range(70))
    (tmp_path / "cut.vecs").write_bytes((tmp_path / "x.vecs").read_bytes()[:-1])
    with pytest.raises(ValueError, match="whole number"):
        sources.read_vectors(spark, f"file://{tmp_path}/cut.vecs")


def test_bad_vector_files_are_refused():
    good = sources.encode(np.ones((3, 4)), "vecs")
    with pytest.raises(ValueError, match="whole number"):
        sources.decode(good[:-1], "vecs")
    with pytest.raises(ValueError, match="changes"):
        sources.decode(good[:20] + (5).to_bytes(4, "little") + good[24:], "vecs")
    with pytest.raises(ValueError, match="do not hold"):
        sources.decode(sources.encode(np.ones((3, 4)), "bin") + b"x", "bin")
    assert sources.decode(b"", "vecs").shape == (0, 0)
    assert sources.decode(sources.encode(np.ones((3, 4)), "bin"), "auto").shape == (3, 4)


def test_truth_and_graph_files(spark, tmp_path):
    truth = np.arange(6, dtype=np.int32).reshape(2, 3)
    (tmp_path / "a.ivecs").write_bytes(sources.encode(truth, "vecs", "int"))
    (tmp_path / "b.bin").write_bytes(sources.encode(truth, "bin", "int") + np.float32(truth / 2).tobytes())
    rows = [(i, k + 1, 3 * i + k) for i in range(2) for k in range(3)]
    assert sorted(map(tuple, sources.read_truth(spark, f"file://{tmp_path}/a.ivecs").collect())) == rows
    assert sorted(map(tuple, sources.read_truth(spark, f"file://{tmp_path}/b.bin", "truth").collect())) == [(*r, r[2] / 2) for r in rows]
    node = np.float32([1, 2]).tobytes() + np.uint32([2, 7, 0xFFFFFFFF, 0]).tobytes()
    (tmp_path / "g").write_bytes(node * 2)
    got = sources.read_graph(spark, f"file://{tmp_path}/g", 2, 3).orderBy("id").collect()
    assert [(r["id"], r["vec"], r["nbrs"]) for r in got] == [(0, [1.0, 2.0], [7]), (1, [1.0, 2.0], [7])]


def test_quantiser_files(spark, tmp_path):
    rng = np.random.default_rng(2)
    pivots, centroid, bounds = rng.normal(size=(256, 6)).astype("<f4"), rng.normal(size=6).astype("<f4"), np.array([0, 2, 6], "<u4")
    parts, at, places = [], 40, []
    for x in (pivots, centroid[:, None], bounds[:, None]):
        places.append(at)
        parts.append(np.array(x.shape, "<i4").tobytes() + x.tobytes())
        at += len(parts[-1])
    raw = np.array([4, 1], "<u4").tobytes() + np.array([*places, at], "<u8").tobytes() + b"".join(parts)
    (tmp_path / "p.bin").write_bytes(raw)
    codes = rng.integers(0, 256, (9, 2)).astype(np.uint8)
    (tmp_path / "c.bin").write_bytes(np.array([9, 2], "<i4").tobytes() + codes.tobytes())
    got = sources.read_pq(spark, f"file://{tmp_path}/p.bin", f"file://{tmp_path}/c.bin")
    subs = {(r["chunk"], r["code"]): r["sub"] for r in got["pivots"].collect()}
    moved = pivots.astype(float) + centroid.astype(float)
    assert len(subs) == 512 and subs[1, 7] == moved[7, 2:].tolist()
    assert [tuple(r) for r in got["chunks"].orderBy("chunk").collect()] == [(0, 0, 2), (1, 2, 6)]
    assert sorted(map(tuple, got["codes"].collect())) == [(i, c, int(codes[i, c])) for i in range(9) for c in range(2)]
    assert got["centroid"].count() == 6
    for bad in (raw[:30], raw[:-4], b"\x05" + raw[1:]):
        with pytest.raises(ValueError):
            sources.pivot_sections(bad)


def test_sector_and_static_files(spark, tmp_path):
    n, dim, r, size, per = 5, 3, 4, 3 * 4 + 4 + 16, 2
    vec = np.arange(n * dim, dtype="<f4").reshape(n, dim)
    nbrs = [[4, 1], [0], [3, 1, 0], [2], [0, 3, 2, 1]]
    raw = bytearray(4096 * 4)
    raw[:80] = np.zeros(2, "<u4").tobytes() + np.array([n, dim, 2, size, per, 0, 0, 0, len(raw)], "<u8").tobytes()
    for i in range(n):
        at = (1 + i // per) * 4096 + i % per * size
        raw[at : at + size] = vec[i].tobytes() + np.array([len(nbrs[i]), *nbrs[i], *[0] * (r - len(nbrs[i]))], "<u4").tobytes()
    (tmp_path / "d.index").write_bytes(raw)
    nodes, meta = sources.read_sectors(spark, f"file://{tmp_path}/d.index", r)
    assert [(x["id"], x["vec"], x["nbrs"]) for x in nodes.orderBy("id").collect()] == [(i, vec[i].tolist(), sorted(nbrs[i])) for i in range(n)]
    assert tuple(meta.first()) == (n, dim, 2, size, per, len(raw))
    assert sources.write_graph(nodes, str(tmp_path / "g"), r) == n
    back = sources.read_graph(spark, f"file://{tmp_path}/g", dim, r).orderBy("id").collect()
    assert [(x["vec"], x["nbrs"]) for x in back] == [(vec[i].tolist(), sorted(nbrs[i])) for i in range(n)]
    with pytest.raises(ValueError, match="over 3"):
        sources.write_graph(nodes, str(tmp_path / "h"), 3)
    (tmp_path / "v.fvecs").write_bytes(sources.encode(vec, "vecs"))
    (tmp_path / "g.ivecs").write_bytes(sources.encode(np.array([[1, -1], [0, 2], [1, -1], [-1, -1]]), "vecs", "int"))
    got = sources.read_static(spark, f"file://{tmp_path}/v.fvecs", f"file://{tmp_path}/g.ivecs").orderBy("id").collect()
    assert [x["nbrs"] for x in got] == [[1], [0, 2], [1], [], []]


def test_truth_and_metrics_are_written(spark, v, q, tmp_path):
    found = knn.knn(q, v, 5)
    rows = sorted((r["qid"], r["rk"], r["id"]) for r in found.collect())
    order = {x: i for i, x in enumerate(sorted({r[0] for r in rows}))}
    for layout in (True, False):
        path = tmp_path / f"t{layout}.bin"
        assert sources.write_truth(found, str(path), 5, layout) == len(order)
        back = sources.read_truth(spark, f"file://{path}", "truth" if layout else "bin").collect()
        assert sorted((r["qid"], r["rk"], r["id"]) for r in back) == [(order[a], b, c) for a, b, c in rows]
    with pytest.raises(ValueError, match="answers"):
        sources.write_truth(found, str(tmp_path / "x.bin"), 6)
    sources.write_metrics(spark.sql("SELECT 1 AS n, 0.5D AS recall"), f"file://{tmp_path}/m")
    assert "".join(p.read_text() for p in (tmp_path / "m").glob("part*")).startswith("n: 1\nrecall: 0.5\n")


# ---- events


def log(spark, n=400, seed=3):
    rng = random.Random(seed)
    rows = [(i, 10 * i, rng.choice(["insert", "insert", "delete", "query"]), rng.randrange(60), [rng.gauss(0, 1) for _ in range(DIM)]) for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "seq long, t long, type string, id long, vec array<double>")


def test_event_files_in_both_dialects(spark, tmp_path):
    lines = [{"type": "metadata", "scenario": "x"}, {"t": 1, "type": "insert", "id": 0, "vec": [1.0]}, {"timestamp": 2.5, "type": "delete", "point_id": 0}, {"timestamp": 3, "type": "query", "query_id": 4, "vector": [2.0]}, {"type": "QUERY"}]
    (tmp_path / "e.json").write_text("\n".join(map(json.dumps, lines)) + "\n{broken\n")
    raw = sources.read_events(spark, f"file://{tmp_path}/e.json").withColumn("seq", F.monotonically_increasing_id())
    got = [(r["type"], r["t"], r["id"], r["vec"]) for r in ev.normalize_dialects(raw).orderBy("seq").collect()]
    assert got == [("insert", 1, 0, [1.0]), ("delete", 2, 0, None), ("query", 3, 4, [2.0])]
    assert ev.bad_records(raw).count() == 2
    sources.write_events(log(spark), f"file://{tmp_path}/out", "x")
    assert sources.read_events(spark, f"file://{tmp_path}/out").count() == 401


def brute_replay(rows):
    live: dict[int, list] = {}
    for r in rows:
        if r["type"] == "insert":
            live[r["id"]] = r["vec"]
        elif r["type"] == "delete":
            live.pop(r["id"], None)
    return live


@pytest.mark.parametrize("threshold", [0.05, 10.0])
def test_streamed_replay_ends_where_the_log_ends(spark, tmp_path, threshold):
    events = log(spark)
    rows = events.orderBy("seq").collect()
    for i in range(4):
        (tmp_path / "in").mkdir(exist_ok=True)
        part = rows[100 * i : 100 * (i + 1)]
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps(r.asDict()) for r in part))
        import os

        os.utime(tmp_path / "in" / f"{i}.json", (1000 + i, 1000 + i))
    static = vectors(spark, 20, 5, 500)
    index = Index(spark, f"file://{tmp_path}/index", static, threshold, 10.0 if threshold > 1 else 0.08, 5)
    replay(spark, f"file://{tmp_path}/in", index, f"file://{tmp_path}/cp")
    want = {**{r["id"]: r["vec"] for r in static.collect()}, **brute_replay(rows)}
    assert {r["id"]: r["vec"] for r in index.live().collect()} == want
    assert ids(ev.live(events)) == set(brute_replay(rows))
    asked = {r["seq"] for r in rows if r["type"] == "query"}
    assert ids(index.answers(), "qid") == asked
    again = spark.createDataFrame([r for r in rows[300:]], events.schema)
    index.apply(again, 3)  # a batch that is delivered twice leaves the same state
    assert {r["id"]: r["vec"] for r in index.live().collect()} == want


def in_files(rows, folder, size=100):
    folder.mkdir(exist_ok=True)
    for i in range(0, len(rows), size):
        (folder / f"{i:05}.json").write_text("\n".join(json.dumps(r.asDict()) for r in rows[i : i + size]))
        os.utime(folder / f"{i:05}.json", (1000 + i, 1000 + i))


def test_an_index_goes_on_after_a_restart(spark, tmp_path):
    events = log(spark)
    rows = events.orderBy("seq").collect()
    root, static = f"file://{tmp_path}/index", vectors(spark, 20, 5, 500)
    in_files(rows[:200], tmp_path / "in")
    replay(spark, f"file://{tmp_path}/in", Index(spark, root, static, 0.3), f"file://{tmp_path}/cp")
    in_files(rows, tmp_path / "in")
    again = Index(spark, root, threshold=0.3)
    replay(spark, f"file://{tmp_path}/in", again, f"file://{tmp_path}/cp")
    assert {r["id"]: r["vec"] for r in again.live().collect()} == {**{r["id"]: r["vec"] for r in static.collect()}, **brute_replay(rows)}
    assert ids(again.answers(), "qid") == {r["seq"] for r in rows if r["type"] == "query"}
    kept = [p.name for p in (tmp_path / "index").iterdir()]
    assert sum(n.startswith("epoch=") for n in kept) == 2 and sum(n.startswith("static=") for n in kept) <= 2
    with pytest.raises(ValueError, match="no index"):
        Index(spark, f"file://{tmp_path}/nowhere")


def test_segments_merge_beside_the_stream(spark, tmp_path):
    events = log(spark)
    rows = events.orderBy("seq").collect()
    static = vectors(spark, 20, 5, 500)
    index = Index(spark, f"file://{tmp_path}/index", static, 0.05, k=5, background=True)
    for i in range(8):
        index.apply(spark.createDataFrame(rows[50 * i : 50 * i + 50], events.schema), i)
        if i == 2:
            index.wait()  # a merge of the first batches has ended; deletes since then must stay
    index.wait()
    assert index.merged and index.segment() > 0
    assert {r["id"]: r["vec"] for r in index.live().collect()} == {**{r["id"]: r["vec"] for r in static.collect()}, **brute_replay(rows)}


def test_timed_batches(spark, tmp_path):
    events = log(spark)
    rows = events.orderBy("seq").collect()
    in_files(rows, tmp_path / "in")
    index = Index(spark, f"file://{tmp_path}/index", vectors(spark, 20, 5, 500), 10.0, 10.0)
    replay(spark, f"file://{tmp_path}/in", index, f"file://{tmp_path}/cp", 2, "1 second", 4)
    assert {r["id"] for r in index.live().collect()} == set(brute_replay(rows)) | set(range(500, 520))


def test_windowed_counts(spark, tmp_path):
    rows = log(spark).orderBy("seq").collect()
    late = [rows[0].asDict() | {"seq": 1000 + i, "t": 15} for i in range(3)]
    in_files(rows, tmp_path / "in", 200)
    read = lambda: counts(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/cp", f"file://{tmp_path}/out", "1 millisecond", "1 microsecond")
    first = {(r["start"], r["type"]): r["n"] for r in read().collect()}
    assert sum(first.values()) == sum(r["t"] < 4000 for r in rows) and len({s for s, _ in first}) == 4
    (tmp_path / "in" / "z.json").write_text("\n".join(map(json.dumps, late)))
    assert {(r["start"], r["type"]): r["n"] for r in read().collect()} == first  # they came too late


def test_deletion_policies_and_drift(spark, v):
    rows = [(1, 1, "insert", 5), (2, 2, "insert", 3), (3, 3, "insert", 9), (4, 4, "query", 5), (5, 5, "delete", 9)]
    got = dict(map(tuple, ev.victims(spark.createDataFrame(rows, "seq long, t long, type string, id long")).collect()))
    assert got == {"fifo": 5, "lru": 3, "clustered_low": 3, "clustered_high": 5}
    for model, how in (("gaussian", {}), ("directional", {"direction": [1.0] * DIM})):
        moved = ev.drift(v, model, 0.1, **how)
        assert moved.where(F.abs(fn.norm(F.col("vec")) - 1) > 1e-9).count() == 0


SCENARIO = ev.Scenario("s", 0.4, 0.2, 0.4, 0.1, "uniform", "gaussian", "fifo", "uniform", 0.0, "decoupled", 1, 10, 0.5)


def play(**how):
    return ev._play(dataclasses.replace(SCENARIO, **how), 3000, 1000, 40, 1)


@pytest.mark.parametrize("policy", ["fifo", "lru", "random", "clustered"])
def test_every_policy_deletes_what_it_says(policy):
    made, live, used = play(deletion_policy=policy, query_coupling="fully_coupled"), [], {}
    inner = 0
    for seq, kind, i, near in made[["seq", "type", "id", "near"]].itertuples(index=False):
        if kind == "insert":
            live.append(i)
            used[i] = seq
        elif near:
            used[i] = seq
        elif kind == "delete":
            if policy == "fifo":
                assert i == live[0]
            elif policy == "lru":
                assert i == min(live, key=used.get)
            elif policy == "clustered":
                assert i in (live[0], live[-1])
            inner += i not in (live[0], live[-1])
            live.remove(i)
    assert inner > 100 if policy == "random" else policy != "fifo" or inner == 0


def test_every_clock_waits_as_it_says():
    waits = {p: np.diff(play(temporal_pattern=p)["t"]) for p in ("uniform", "poisson", "burst_decay")}
    assert (waits["uniform"] == 1).all()
    assert waits["poisson"].min() == 1 and 1.9 < waits["poisson"].mean() < 2.5
    burst, decay = waits["burst_decay"][:499], waits["burst_decay"][499:999]
    assert set(burst) == {1, 2, 3, 4} and decay.tolist() == [max(1, int(10 / (0.9**i + 0.1))) for i in range(500)]


def test_queries_follow_their_distribution_and_coupling(spark, v, q):
    share = {d: np.bincount(play(query_distribution=d, query_skew_alpha=1.2).query("type == 'query'")["id"], minlength=40) for d in ("uniform", "zipfian", "gaussian")}
    assert share["uniform"].max() < 2 * share["uniform"].mean()
    assert share["zipfian"][0] > 5 * share["zipfian"][20:].mean() and share["gaussian"][16:24].sum() > 2 * share["gaussian"][:8].sum()
    for coupling, low, high in (("decoupled", 0, 0), ("semi_coupled", 0.2, 0.4), ("fully_coupled", 0.95, 1)):
        asked = play(query_coupling=coupling).query("type == 'query'")
        assert low <= asked["near"].mean() <= high
    made = spark.createDataFrame(ev._play(dataclasses.replace(SCENARIO, query_coupling="fully_coupled"), 200, 300, 15, 1), ev.MADE)
    queries = q.select(F.floor(F.col("qid") % 1000).alias("id"), F.col("qvec").alias("vec"))
    resolved = {r["seq"]: r["id"] for r in ev.coupled(made, v, queries).collect()}
    base, asked = ({r["id"]: np.array(r["vec"]) for r in t.collect()} for t in (v, queries))
    for r in made.where("near").collect():
        assert resolved[r["seq"]] == min(asked, key=lambda a, x=base[r["id"]]: (((asked[a] - x) ** 2).sum(), a))
    moved = ev.with_vectors(ev.coupled(made, v, queries), v, queries, SCENARIO)
    assert moved.where("type = 'insert' AND vec IS NULL OR type = 'query' AND vec IS NULL").count() == 0


def test_generating_stops_at_the_pool_and_repeats(spark):
    one, two = (ev.generate(spark, ev.SCENARIOS, 600, 100, 10).orderBy("scenario", "seq").collect() for _ in range(2))
    assert one == two and len(one) == 8 * 600
    assert max(r["id"] for r in one if r["type"] == "insert") == 99
    assert ev.generate(spark, ev.SCENARIOS[:1], 0, 100, 10).count() == 0
    assert play(insert_ratio=0.0)["type"].isin(["query"]).all()  # nothing to delete


def test_no_task_makes_a_whole_scenario(spark, monkeypatch):
    """Blocks of 128 events, each drawn by itself, make one log: exact numbers, rising time, deletes as the policy says; where nothing is live any more, too."""
    monkeypatch.setattr(ev, "MADE_BLOCK", 128)
    by = {s.name: s for s in ev.SCENARIOS}
    made = ev.generate(spark, ev.SCENARIOS, 3000, 700, 40).withColumn("part", F.spark_partition_id()).toPandas().sort_values(["scenario", "seq"])
    assert made.groupby(["scenario", "part"]).size().max() < 1500 and set(made["scenario"]) == set(by)
    for name, rows in made.groupby("scenario"):
        s, used = by[name], {}
        given = int(700 * s.base_init_ratio)
        assert rows["seq"].tolist() == list(range(1, 3001)) and (np.diff(rows["t"]) > 0).all()
        for seq, kind, i, near in rows[["seq", "type", "id", "near"]].itertuples(index=False):
            if kind == "insert":
                assert i == given
                given, used[i] = given + 1, seq
            elif kind == "delete":
                assert i in used and (s.deletion_policy != "fifo" or i == min(used)) and (s.deletion_policy != "lru" or i == min(used, key=used.get))
                del used[i]
            elif near:
                assert given - s.locality_window <= i < given
                used.update({i: seq} if i in used else {})
            else:
                assert 0 <= i < 40
        assert (rows["type"] == "insert").sum() == min(int(3000 * s.insert_ratio), 700 - int(700 * s.base_init_ratio))
    few = ev.generate(spark, ev.SCENARIOS, 3000, 40, 5).where("type = 'delete'").groupBy("scenario").count().collect()
    assert len(few) == 8 and all(r["count"] <= 40 - int(40 * by[r["scenario"]].base_init_ratio) for r in few)


def test_violations_are_counted(spark):
    rows = [(1, 5, "insert", 1), (2, 4, "delete", 2), (3, 6, "odd", None)]
    got = ev.violations(spark.createDataFrame(rows, "seq long, t long, type string, id long")).first()
    assert (got["n"], got["n_back"], got["n_type"], got["n_id"], got["n_orphan_deletes"]) == (3, 1, 1, 1, 1)
