"""State by id, batches by events, temporal truth by blocks, bitmaps, and the table function."""

from __future__ import annotations

import json
import os
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lodestone.operators import events as ev
from lodestone.operators import graph, knn
from lodestone.streaming import Index, live_state, replay


def write(folder, rows, size, order=None):
    """rows in files of size, written in the given order of files, so that their times are in that order."""
    os.makedirs(folder, exist_ok=True)
    parts = [rows[a : a + size] for a in range(0, len(rows), size)]
    for n, i in enumerate(order or range(len(parts))):
        path = f"{folder}/{i:03d}.json"
        with open(path, "w") as f:
            f.write("\n".join(json.dumps(r) for r in parts[i]))
        os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))


def log(n, seed=1, ids=25):
    rng = random.Random(seed)
    return [{"seq": i, "t": i // 3, "type": rng.choice(["insert", "delete", "query"]), "id": rng.randrange(ids), "vec": [rng.gauss(0, 1) for _ in range(3)]} for i in range(1, n + 1)]


def last(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["t"], r["seq"])):
        if r["type"] != "query":
            i, d = (out[r["id"]][2:] if r["id"] in out else (0, 0))
            out[r["id"]] = (r["type"] == "insert", r["seq"], i + (r["type"] == "insert"), d + (r["type"] == "delete"))
    return out


def test_state_by_id_goes_on_after_a_restart(spark, tmp_path):
    rows = log(200)
    conf = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    source, where = str(tmp_path / "in"), (str(tmp_path / "c"), str(tmp_path / "out"))
    write(source, rows[:120], 40, [2, 0, 1])  # a later part of the log comes first
    first = live_state(spark, source, *where)
    assert {r["id"]: (r["live"], r["seq"], r["inserts"], r["deletes"]) for r in first.collect()} == last(rows[:120])
    write(source, rows, 40)
    again = live_state(spark, source, *where)
    assert {r["id"]: (r["live"], r["seq"], r["inserts"], r["deletes"]) for r in again.collect()} == last(rows)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == conf


def test_batches_have_at_most_so_many_events_in_their_order(spark, tmp_path):
    rows = log(130, 2)
    shuffled = random.Random(5).sample(rows, len(rows))
    write(str(tmp_path / "in"), shuffled, 50)
    static = spark.createDataFrame([(i, [0.0] * 3) for i in range(25)], "id long, vec array<double>")
    index = Index(spark, str(tmp_path / "i"), static, threshold=10, fresh_share=10)
    taken = []
    apply = index.apply
    index.apply = lambda df, epoch: (taken.append([(r["t"], r["seq"]) for r in df.collect()]), apply(df, epoch))[1]
    replay(spark, str(tmp_path / "in"), index, str(tmp_path / "c"), files_per_batch=9, events=40)
    assert [len(b) for b in taken] == [40, 40, 40, 10]
    assert [x for b in taken for x in sorted(b)] == sorted((r["t"], r["seq"]) for r in rows) and index.epoch == 4
    want = {i for i in range(25)} - {i for i, x in last(rows).items() if not x[0]}
    assert {r["id"] for r in index.live().collect()} == want
    write(str(tmp_path / "in2"), [dict(r, seq=r["seq"] + 1000, t=r["t"] + 1000) for r in rows], 200)
    os.rename(tmp_path / "in2/000.json", tmp_path / "in/900.json")
    replay(spark, str(tmp_path / "in"), index, str(tmp_path / "c"), files_per_batch=9, events=40)
    assert index.epoch == 8 and sorted(os.listdir(tmp_path / "i/batches")) == ["0", "1"]


def test_batches_of_a_trigger_read_their_own_files_only(spark, tmp_path):
    """A batch costs what it holds, however many a trigger has, and few jobs."""
    write(str(tmp_path / "in"), log(130, 2), 50)
    static = spark.createDataFrame([(i, [float(i)] * 3) for i in range(25)], "id long, vec array<double>")
    index = Index(spark, str(tmp_path / "i"), static, threshold=10, fresh_share=10)
    read, jobs, apply = [], [], index.apply
    nth = lambda: spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()

    def counted(df, epoch):
        read.append(set(df.inputFiles()))
        before = nth()
        apply(df, epoch)
        jobs.append(nth() - before)

    index.apply = counted
    replay(spark, str(tmp_path / "in"), index, str(tmp_path / "c"), files_per_batch=9, events=40)
    assert len(read) == 4 and sum(map(len, read)) == len(set.union(*read))
    assert max(jobs) < 40, jobs
    assert {r["qid"] for r in index.answers().collect()} == {r["seq"] for r in log(130, 2) if r["type"] == "query" and r.get("vec")}


@pytest.mark.parametrize(("block", "part"), [(4096, 50_000), (7, 3), (1, 1)])
def test_temporal_truth_matches_brute_force(spark, monkeypatch, block, part):
    monkeypatch.setattr(ev, "BLOCK", block)
    monkeypatch.setattr(ev, "PART", part)
    rng = random.Random(3)
    vec = {i: [rng.gauss(0, 1) for _ in range(3)] for i in range(12)}
    rows = [(i, i, rng.choice(["insert", "delete", "query", "query"]), rng.randrange(14)) for i in range(1, 90)]
    events = spark.createDataFrame(rows, "seq long, t long, type string, id long")
    v = spark.createDataFrame(list(vec.items()), "id long, vec array<double>")
    q = v.where("id % 2 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    live, want = set(), []
    for seq, _, kind, i in rows:
        if kind == "query" and i in vec and i % 2 == 0:
            near = sorted((float(np.cumsum([(a - b) * (a - b) for a, b in zip(vec[i], vec[j])])[-1]), j) for j in live if j in vec)[:3]
            want += [(seq, k + 1, j, d) for k, (d, j) in enumerate(near)]
        elif kind == "insert":
            live.add(i)
        elif kind == "delete":
            live.discard(i)
    found = ev.temporal_knn(events, q, v)
    assert sorted(map(tuple, found.collect())) == sorted(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin Inner BuildRight, ((" not in plan


def test_bitmaps_hold_what_is_deleted(spark):
    ids = [-70_000, -32_768, -32_767, -1, 0, 1, 7, 32_768, 32_769, 65_536, 65_537, 10**12]
    dead = spark.createDataFrame([(i,) for i in ids for _ in range(2)] + [(None,)], "id long")
    bits = graph.deleted_bitmap(dead)
    assert bits.agg(F.sum(F.bitmap_count("bits"))).first()[0] == len(ids)
    asked = sorted({i + d for i in ids for d in (-2, -1, 0, 1, 2)})
    df = spark.createDataFrame([(i, "x") for i in asked], "id long, note string")
    assert {r["id"] for r in graph.in_bitmap(df, bits).where("deleted").collect()} == set(ids)
    assert graph.in_bitmap(df, bits).columns == ["id", "note", "deleted"]
    assert np.array(asked)[graph.gone_among(np.array(asked), dead)].tolist() == ids
    both = graph.join_bitmaps(bits, graph.deleted_bitmap(spark.createDataFrame([(2,), (7,)], "id long")))
    assert both.agg(F.sum(F.bitmap_count("bits"))).first()[0] == len(ids) + 1
    assert not graph.gone_among(np.array([1, 2]), None).any() and graph.gone_among(np.zeros(0, np.int64), dead).shape == (0,)
    assert graph.deleted_bitmap(dead.limit(0)).count() == 0


def test_the_table_function_answers_in_sql(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(60, 4)))], "id long, vec array<double>")
    q = v.where("id < 7").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    knn.register_knn(spark, v, "near_vectors")
    q.createOrReplaceTempView("asked")
    found = spark.sql("SELECT a.qid, n.rk, n.id, n.dist FROM asked a, LATERAL near_vectors(a.qvec, 4) n").collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, knn.knn(q, v, 4).collect()))
    assert spark.sql("SELECT * FROM near_vectors(CAST(NULL AS ARRAY<DOUBLE>), 4)").count() == 0
    monkeypatch.setattr(knn, "TABLE_BYTES", 100)
    with pytest.raises((ValueError, PySparkException), match="more than a table function"):
        knn.register_knn(spark, v)
