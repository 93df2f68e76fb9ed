"""Indexes that change: repeated rows, replaced vectors, epochs of several writers, growing, shards, and the graph under a stream."""

from __future__ import annotations

import json
import os
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph, knn, metrics, shards, snapshot
from lodestone.plans import QUERIES
from lodestone.streaming import Index, replay
from lodestone.streaming.graph_index import GraphIndex

DIM = 8


def vectors(spark, n, seed=1, first=0):
    rng = np.random.default_rng(seed)
    return snapshot.materialize(spark.createDataFrame([(first + i, x.tolist()) for i, x in enumerate(rng.normal(size=(n, DIM)))], "id long, vec array<double>"))


def queries(spark, n, seed=2):
    return snapshot.materialize(vectors(spark, n, seed).withColumnsRenamed({"id": "qid", "vec": "qvec"}))


def plain_walk(q, vecs, nbrs, start, beam, k):
    dist = lambda i: sum((a - b) ** 2 for a, b in zip(q, vecs[i]))
    work, seen, done = [(dist(start), start)], {start}, set()
    while left := [w for w in work if w[1] not in done]:
        done.add(left[0][1])
        new = nbrs.get(left[0][1], set()) - seen
        seen |= new
        work = sorted(work + [(dist(i), i) for i in new if i in vecs])[:beam]
    return [i for _, i in work[:k]], len([i for i in seen if i in vecs])


@pytest.mark.parametrize("limit", [1 << 28, 0])
def test_repeated_edges_and_ids_count_once(spark, monkeypatch, limit):
    monkeypatch.setattr(graph, "GRAPH_BYTES", limit)
    for seed in range(2):
        rng = random.Random(seed)
        v = {i: [rng.random(), rng.random()] for i in range(14)}
        pairs = [(i, rng.choice([j for j in range(15) if j != i])) for i in range(14) for _ in range(3)]
        nbrs: dict[int, set[int]] = {}
        for a, b in pairs:
            nbrs.setdefault(a, set()).add(b)
        q = [[0.1, 0.2], [0.9, 0.4], [0.5, 0.5]]
        rows = [*v.items(), *[(i, v[i]) for i in (1, 4, 4)], (3, [9.0, 9.0])]  # the larger vector of an id does not count
        found = graph.greedy_search(
            spark.createDataFrame(list(enumerate(q)), "qid long, qvec array<double>"), spark.createDataFrame(rows, "id long, vec array<double>"),
            spark.createDataFrame([*pairs, *pairs[::2], *pairs[::3], (0, 0)], "src long, dst long"), 0, 3, 3,
        ).collect()
        for i, x in enumerate(q):
            mine = sorted((r["rk"], r["id"], r["evals"]) for r in found if r["qid"] == i)
            ids, cost = plain_walk(x, v, nbrs, 0, 3, 3)
            assert [m[1] for m in mine] == ids and {m[2] for m in mine} == {cost}


def test_events_without_vectors_are_no_events(spark, tmp_path):
    rows = [
        {"seq": 1, "t": 1, "type": "insert", "id": 100, "vec": [1.0] * DIM}, {"seq": 2, "t": 2, "type": "insert", "id": 100}, {"seq": 3, "t": 3, "type": "delete", "id": 1},
        {"seq": 4, "t": 4, "type": "insert", "id": 1}, {"seq": 5, "t": 5, "type": "insert", "id": 200}, {"seq": 6, "t": 6, "type": "query", "id": 1},
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(json.dumps(r) for r in rows))
    static = vectors(spark, 20)
    want = {i for i in range(20) if i != 1} | {100}
    index = Index(spark, str(tmp_path / "i"), static, threshold=10)
    replay(spark, str(tmp_path / "in"), index, str(tmp_path / "c"))
    assert {r["id"] for r in index.live().collect()} == want
    one = GraphIndex(spark, str(tmp_path / "g"), static, threshold=10)
    replay(spark, str(tmp_path / "in"), one, str(tmp_path / "d"))
    assert {r["id"] for r in one.live().collect()} == want and one.answers().count() == 0


def test_fixtures_follow_their_files(spark, tmp_path):
    def write(n):
        v = vectors(spark, n).select(F.col("id").alias("vec_id"), F.concat("vec", *["vec"] * 7).alias("embedding"), F.lit(1).alias("label"))
        v.coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
        return QUERIES["q_out_degree"](spark, str(tmp_path)).agg(F.count("*"), F.sum("degree")).first()

    assert tuple(write(100)) == (100, 800) and tuple(write(200)) == (200, 1600)


# ---- replaced vectors, epochs


def whole(t, r=6):
    v = [x["id"] for x in t["vectors"].collect()]
    e = [(x["src"], x["dst"]) for x in t["edges"].collect()]
    assert len(v) == len(set(v)) and len(e) == len(set(e)) and all(a != b for a, b in e)
    assert {x for p in e for x in p} <= set(v)
    degree: dict[int, int] = {}
    for a, _ in e:
        degree[a] = degree.get(a, 0) + 1
    assert max(degree.values()) <= r


def found_first(spark, root, id_, vec, start):
    q = spark.createDataFrame([(0, vec)], "qid long, qvec array<double>")
    return [r["id"] for r in graph.search_epoch(spark, root, q, start, 24, 3).orderBy("rk").collect()][0] == id_


def test_inserts_replace_what_is_there_and_bring_back_what_is_deleted(spark, tmp_path):
    v = vectors(spark, 200)
    root = str(tmp_path / "x")
    dead = spark.createDataFrame([(i,) for i in range(0, 200, 9)], "id long")
    snapshot.write_epoch(root, 0, vectors=v, edges=graph.build(v, passes=0), tombstones=dead)
    start = graph.medoid(v)
    old = {r["id"]: list(r["vec"]) for r in v.collect()}
    beside = lambda i: [x + 0.01 for x in old[i]]
    new = spark.createDataFrame([(9, beside(100)), (5, beside(120)), (5, beside(120)), (900, beside(140)), (start, beside(160))], "id long, vec array<double>")
    assert graph.insert_epoch(spark, root, new, start) == 1
    _, t = snapshot.read_epoch(spark, root)
    whole(t)
    assert t["vectors"].count() == 201 and {r["id"] for r in t["tombstones"].collect()} == set(range(0, 200, 9)) - {9, start}
    assert found_first(spark, root, 9, beside(100), start) and found_first(spark, root, 5, beside(120), start)
    assert not t["edges"].join(dead.where(f"id NOT IN (9, {start})").select(F.col("id").alias("dst")), "dst").join(new.select(F.col("id").alias("src")), "src").count()
    assert graph.delete_epoch(spark, root, spark.createDataFrame([(9,), (12345,)], "id long")) == 2
    assert not found_first(spark, root, 9, beside(100), start)


def test_two_writers_lose_nothing(spark, tmp_path):
    v = vectors(spark, 100)
    root = str(tmp_path / "x")
    snapshot.write_epoch(root, 0, vectors=v, edges=graph.build(v, passes=0), tombstones=v.select("id").where("id % 10 = 1"))
    with pytest.raises(snapshot.EpochTaken):
        snapshot.write_epoch(root, 0, vectors=v)
    new = [vectors(spark, 3, 7 + i, 1000 * (i + 1)) for i in range(3)]
    failed = []

    def run(work):
        try:
            work()
        except Exception as e:
            failed.append(e)

    work = [lambda x=x: graph.insert_epoch(spark, root, x, 0) for x in new] + [lambda: graph.consolidate_epoch(spark, root), lambda: graph.delete_epoch(spark, root, v.select("id").where("id % 10 = 2"))]
    threads = [threading.Thread(target=run, args=(w,)) for w in work]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    last, t = snapshot.read_epoch(spark, root)
    assert last == 5
    whole(t)
    dead = {r["id"] for r in t["tombstones"].collect()}
    here = {r["id"] for r in t["vectors"].collect()}
    assert here - dead == {i for i in range(100) if i % 10 not in (1, 2)} | {1000 * (i + 1) + j for i in range(3) for j in range(3)}
    assert all(found_first(spark, root, r["id"], r["vec"], 0) for x in new for r in x.limit(1).collect())
    assert len([n for n in os.listdir(root) if n.startswith("epoch=")]) == 6  # what lost is removed


# ---- growing


def test_graphs_grow_from_nothing(spark, monkeypatch):
    work = []
    search = graph.greedy_search

    def counted(*args, **how):
        found = snapshot.materialize(search(*args, **how))
        work.append(found.groupBy("qid").agg(F.max("evals").alias("n")).agg(F.sum("n")).first()[0] or 0)
        return found

    pairs = knn.pairs
    largest = []
    monkeypatch.setattr(knn, "pairs", lambda q, v: (largest.append(q.count() * v.count()), pairs(q, v))[1])
    monkeypatch.setattr(graph, "greedy_search", counted)
    sums = {}
    for n in (400, 1600):
        v = vectors(spark, n)
        work.clear()
        edges = graph.build(v, r=10, beam=24, passes=0, first=50)
        sums[n] = sum(work)
        q = queries(spark, 40)
        found = search(q, v, edges, graph.medoid(v), 32, 10)
        assert metrics.recall(knn.knn(q, v, 10), found, (10,)).first()["recall"] >= 90
    assert sums[1600] / sums[400] < (1600 / 400) ** 1.5
    assert max(largest[:1] + largest[-1:]) < 200 * 200 or len(largest) == 4  # only first batches, and the two truths
    empty = graph.build(spark.createDataFrame([], "id long, vec array<double>"))
    assert empty.count() == 0
    assert graph.build(vectors(spark, 1)).count() == 0 and graph.build(vectors(spark, 2).unionAll(vectors(spark, 2))).count() == 2


# ---- shards


def test_shards_find_what_is_near(spark, tmp_path):
    v = vectors(spark, 1500)
    crowd = vectors(spark, 1, 5, 0).select(F.explode(F.sequence(F.lit(5000).cast("long"), F.lit(5699).cast("long"))).alias("id"), "vec")  # a third of all vectors are one
    everything = snapshot.materialize(v.unionByName(crowd))
    index = shards.ShardedIndex.build(everything, str(tmp_path / "s"), limit=200, r=10)
    sizes = [r["count"] for r in index.nodes.groupBy("shard").count().collect()]
    assert max(sizes) <= 300 and len(sizes) >= 15 and {r["n"] for r in index.nodes.groupBy("id").agg(F.count("*").alias("n")).collect()} <= {1, 2}
    assert index.nodes.select("id").distinct().count() == 2200
    q = queries(spark, 60)
    truth = knn.knn(q, everything, 10)
    found = snapshot.materialize(index.search(q, 10))
    assert metrics.recall(truth, found, (10,)).first()["recall"] >= 90
    assert found.groupBy("qid").agg(F.countDistinct("id").alias("n")).where("n <> 10").count() == 0
    again = snapshot.materialize(index.search(q, 10))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, again.collect()))
    dead = everything.select("id").where("id % 3 = 0")
    live = snapshot.materialize(index.search(q, 10, tombstones=dead))
    assert live.where("id % 3 = 0").count() == 0
    assert metrics.recall(knn.knn(q, everything, 10, dead), live, (10,)).first()["recall"] >= 90
    assert found.agg(F.max("evals")).first()[0] < 4 * 2200


def test_shards_many_queries_ask_for_and_odd_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "QUERIES", 7)
    v = vectors(spark, 120)
    index = shards.ShardedIndex.build(v, str(tmp_path / "s"), limit=1000)
    q = queries(spark, 50)
    found = index.search(q, 5, probes=9, beam=64)
    assert sorted((r["qid"], r["rk"], r["id"]) for r in found.collect()) == sorted((r["qid"], r["rk"], r["id"]) for r in knn.knn(q, v, 5).collect())
    assert index.search(q.limit(0)).count() == 0
    assert index.search(q, tombstones=v.select("id")).count() == 0
    none = shards.ShardedIndex.build(v.limit(0), str(tmp_path / "n"))
    assert none.search(q).count() == 0 and none.edges().count() == 0
    one = shards.ShardedIndex.build(v.limit(1), str(tmp_path / "o"))
    assert one.search(q, 3).count() == 50


def test_the_edges_of_all_shards_are_a_graph(spark, tmp_path):
    v = vectors(spark, 800)
    edges = snapshot.materialize(shards.ShardedIndex.build(v, str(tmp_path / "s"), limit=200, r=10).edges(10))
    whole({"vectors": v, "edges": edges}, 10)
    q = queries(spark, 40)
    assert metrics.recall(knn.knn(q, v, 10), graph.greedy_search(q, v, edges, graph.medoid(v), 40, 10), (10,)).first()["recall"] >= 90


# ---- the graph under a stream


def log(seed, n=60):
    """Batches of events over ids 0 to 59: new, known, replaced, deleted and unknown ones, with other vectors each time."""
    rng = random.Random(seed)
    out, seq = [], 0
    for _ in range(3):
        batch = []
        for _ in range(n):
            seq += 1
            kind = rng.choices(["insert", "delete", "query"], [2, 2, 1])[0]
            batch.append((seq, seq // 3, kind, rng.randrange(60) if kind != "query" else rng.randrange(9), [rng.gauss(0, 1) for _ in range(DIM)] if kind != "delete" and rng.random() < 0.9 else None))
        out.append(batch)
    return out


EVENTS = "seq long, t long, type string, id long, vec array<double>"


def by_tables(spark, v, edges, batches, start, k=5, beam=24):
    """The same by whole tables: insert, then search."""
    gone = spark.createDataFrame([], "id long")
    answers = []
    for batch in batches:
        last: dict[int, tuple] = {}
        for e in sorted(batch, key=lambda e: (e[1], e[0])):
            if e[2] == "delete" or e[2] == "insert" and e[4]:
                last[e[3]] = e
        new = spark.createDataFrame([(i, e[4]) for i, e in last.items() if e[2] == "insert"], "id long, vec array<double>")
        deleted = spark.createDataFrame([(i,) for i, e in last.items() if e[2] == "delete"], "id long")
        known = snapshot.materialize(deleted.join(v, "id", "left_semi"))
        edges = graph.insert(v, edges, new, start, 6, graph.ALPHA, beam, gone.union(deleted))
        v = snapshot.materialize(v.join(new, "id", "left_anti").unionByName(new))
        gone = snapshot.materialize(gone.union(known).distinct().join(new, "id", "left_anti"))
        asked = spark.createDataFrame([(e[0], e[4]) for e in batch if e[2] == "query" and e[4]], "qid long, qvec array<double>")
        answers += graph.greedy_search(asked, v, edges, start, beam, k, gone).select("qid", "rk", "id", "dist").collect()
    return v, edges, gone, answers


def state(vectors, edges, gone):
    return sorted((r["id"], tuple(r["vec"])) for r in vectors.collect()), sorted((r["src"], r["ord"], r["dst"], r["dist"]) for r in edges.select("src", "ord", "dst", "dist").collect()), sorted(r["id"] for r in gone.collect())


def test_a_stream_changes_the_graph_as_tables_do(spark, tmp_path):
    v = vectors(spark, 40)
    edges = snapshot.materialize(graph.build(v, passes=0))
    batches = log(4)
    index = GraphIndex(spark, str(tmp_path / "g"), v, edges, threshold=10, share=10, k=5)
    frames = [spark.createDataFrame(b, EVENTS) for b in batches]
    for i, df in enumerate(frames):
        index.apply(df, i)
        if i == 1:
            before = state(*index.tables())
            index.apply(df, i)  # comes twice
            assert state(*index.tables()) == before
            index = GraphIndex(spark, str(tmp_path / "g"), threshold=10, share=10, k=5)  # goes on from what is there
    want = by_tables(spark, v, edges, batches, graph.medoid(v))
    assert state(*index.tables()) == state(*want[:3])
    mine = sorted(map(tuple, index.answers().collect()))
    assert mine == sorted(map(tuple, want[3])) and len(mine) > 50
    whole(dict(zip(("vectors", "edges"), index.tables())))


@pytest.mark.parametrize("limit", [1 << 28, 0])
def test_a_streamed_graph_is_repaired_and_finds_what_is_near(spark, tmp_path, monkeypatch, limit):
    """In place and, beyond the limit, by whole segments."""
    v = vectors(spark, 120 if limit else 14)
    index = GraphIndex(spark, str(tmp_path / "g"), v, threshold=0.1, share=0.5, k=10, r=8)
    monkeypatch.setattr(graph, "GRAPH_BYTES", limit)
    batches = log(6)[:3] if limit else log(6, 12)[:1]
    for i, b in enumerate(batches):
        index.apply(spark.createDataFrame(b, EVENTS), i)
    live = {i: None for i in range(120 if limit else 14)}
    for e in sorted((e for b in batches for e in b), key=lambda e: (e[1], e[0])):
        if e[2] == "insert" and e[4]:
            live[e[3]] = e[4]
        elif e[2] == "delete":
            live.pop(e[3], None)
    found = {r["id"]: list(r["vec"]) for r in index.live().collect()}
    assert set(found) == set(live) and all(x is None or found[i] == x for i, x in live.items())
    state = index.state(index.epoch)
    assert state["since"] > 0 and state["segment"].startswith(f"segment={state['since']}-")
    names = [n for n in os.listdir(tmp_path / "g") if n.startswith(("segment=", "delta="))]
    assert len(names) <= 2 + len(batches)
    q = queries(spark, 30 if limit else 2)
    asked = q.select(F.col("qid").alias("seq"), F.lit(1).cast("long").alias("t"), F.lit("query").alias("type"), F.lit(0).cast("long").alias("id"), F.col("qvec").alias("vec"))
    index.apply(asked, len(batches))
    answers = spark.read.parquet(str(tmp_path / f"g/answers/epoch={len(batches)}"))
    assert metrics.recall(knn.knn(q, index.live(), 10), answers, (10,)).first()["recall"] >= 90


def test_an_empty_index_begins_with_its_first_batch(spark, tmp_path):
    index = GraphIndex(spark, str(tmp_path / "g"), vectors(spark, 1).limit(0), k=3)
    index.apply(spark.createDataFrame([(1, 1, "query", 0, [0.0] * DIM), (2, 2, "delete", 5, None)], EVENTS), 0)
    assert index.answers().count() == 0 and index.live().count() == 0
    rows = [(i, i, "insert", i, [float(i)] * DIM) for i in range(1, 8)] + [(9, 9, "query", 0, [0.0] * DIM)]
    index.apply(spark.createDataFrame(rows, EVENTS), 1)
    assert [r["id"] for r in index.answers().orderBy("rk").collect()] == [1, 2, 3]
    with pytest.raises(ValueError, match="no index"):
        GraphIndex(spark, str(tmp_path / "none"))


def test_a_batch_writes_what_it_changes(spark, tmp_path):
    """Rows written by a batch of ten inserts are as many over a graph of four times the nodes."""
    rows = {}
    for n in (100, 400):
        v = vectors(spark, n)
        index = GraphIndex(spark, str(tmp_path / f"g{n}"), v, threshold=10, share=10)
        new = [(i, i, "insert", 10_000 + i, x["vec"]) for i, x in enumerate(vectors(spark, 10, 3).collect())]
        index.apply(spark.createDataFrame(new, EVENTS), 0)
        rows[n] = spark.read.parquet(str(tmp_path / f"g{n}/delta=1/lists")).count()
    assert rows[400] < 1.3 * rows[100] and rows[400] <= 10 * 6 * 7


def test_walks_by_inner_product(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (x * s).tolist()) for i, (x, s) in enumerate(zip(rng.normal(size=(300, DIM)), rng.uniform(1, 2, 300)))]  # of very different lengths
    v, q = spark.createDataFrame(rows, "id long, vec array<double>"), queries(spark, 30)
    base, asked = (snapshot.materialize(x) for x in graph.mips_tables(v, q))
    found = graph.greedy_search(asked, base, graph.build(base, r=16, beam=40, passes=1), graph.medoid(base), 64, 5).collect()
    x = np.array([r[1] for r in rows])
    hits = 0
    for r in q.collect():
        best = set(np.argsort(-(x @ np.array(r["qvec"])))[:5].tolist())
        hits += len(best & {f["id"] for f in found if f["qid"] == r["qid"]})
    assert hits >= 0.9 * 150


@pytest.mark.parametrize("limit", [1 << 28, 0])
def test_repeated_codes_count_once(spark, monkeypatch, limit):
    monkeypatch.setattr(graph, "GRAPH_BYTES", limit)
    v, q = vectors(spark, 40), queries(spark, 3)
    edges = snapshot.materialize(graph.knn_graph(v, 4))
    pivots = snapshot.materialize(knn.pivots(v, 8, 2, 4))
    codes, table = snapshot.materialize(knn.encode(v, pivots, 2, 4)), snapshot.materialize(knn.distance_table(q, pivots, 2, 4))
    want = sorted(map(tuple, graph.pq_search(q, v, codes, table, edges, 0, 4, 3).collect()))
    twice = lambda df: df.unionByName(df.limit(17))
    assert sorted(map(tuple, graph.pq_search(q, v, twice(codes), twice(table), twice(edges), 0, 4, 3).collect())) == want and len(want) == 9


def test_probes_grow_until_the_share_asked_for_is_found(spark, tmp_path):
    rng = np.random.default_rng(3)
    v = spark.createDataFrame([(i, rng.normal(size=32).tolist()) for i in range(2000)], "id bigint, vec array<double>")
    q = v.where("id % 10 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    index = shards.ShardedIndex.build(v, str(tmp_path / "s"), limit=100)
    truth = snapshot.materialize(knn.knn(q, v, 10))
    assert metrics.recall(truth, index.search(q, 10, probes=2), (10,)).first()["recall"] < 90
    assert metrics.recall(truth, index.search(q, 10, probes=2, least=0.9), (10,)).first()["recall"] >= 90


def test_an_insert_keeps_the_distances_that_its_search_found(spark, monkeypatch):
    """What a walk met is not joined with both vectors again: of the new vectors' candidates none, of the nodes linked back one table of pairs."""
    rng = np.random.default_rng(11)
    v = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(60)], "id bigint, vec array<double>")
    old, new = v.where("id < 50"), v.where("id >= 50")
    base = graph.build(old, passes=0)
    asked, plain = [], graph.with_distances
    monkeypatch.setattr(graph, "with_distances", lambda pairs, *a: asked.append(pairs) or plain(pairs, *a))
    edges = graph.insert(old, base, new, 0)
    assert len(asked) == 1
    vecs = {r["id"]: np.array(r["vec"]) for r in v.collect()}
    for r in edges.collect():
        d = vecs[r["src"]] - vecs[r["dst"]]
        assert r["dist"] == np.cumsum(d * d)[-1]
