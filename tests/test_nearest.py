"""Exact search through a grid: the same rows as pairs give, on odd vectors too, and no pair is a row."""

from __future__ import annotations

import math

import numpy as np
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from lodestone.operators import graph, knn
from lodestone.plans import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
ODD = [None, [1.0, 2.0, 3.0], [1.0, None, 0.0, 0.0], [math.nan, 0.0, 0.0, 0.0], [math.inf, 0.0, 0.0, 0.0], [1e200, 0.0, 0.0, 0.0], [1.0, 0.0, 0.0, 0.0, 9.0], [1.0, 2.0, 0.0, -0.0]]


def table(spark, n: int, names: str):
    """Random, gridded and odd vectors; of many ids the same."""
    rng = np.random.default_rng(n)
    rows = [(i, ODD[i % 17] if i % 17 < len(ODD) else (rng.integers(-2, 3, 4) if i % 2 else rng.normal(size=4)).astype(float).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, f"{names[0] if len(names) == 1 else ''}id bigint, {names[0] if len(names) == 1 else ''}vec array<double>")


def same(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize("cell", [knn.CELL, 2000])
@pytest.mark.parametrize("k", [1, 5, 200])
def test_a_grid_finds_what_pairs_do(spark, monkeypatch, k, cell):
    monkeypatch.setattr(knn, "CELL", cell)
    v, q = table(spark, 150, ""), table(spark, 40, "q")
    assert same(knn.nearest(q, v, k, 4)) == same(knn.top(knn.distances(q, v, 4), "qid", k).select("qid", "rk", "id", "dist"))
    assert knn.nearest(q, v.limit(0), k, 4).count() == 0 == knn.nearest(q.limit(0), v, k, 4).count()


def test_within_finds_all_up_to_a_bound(spark):
    v = table(spark, 150, "")
    q = table(spark, 40, "q").withColumn("bound", F.when(F.col("qid") % 4 == 0, F.lit(math.nan)).when(F.col("qid") % 4 == 1, F.lit(math.inf)).when(F.col("qid") % 4 == 2, F.lit(6.0)))
    want = knn.distances(q, v, 4).where("dist <= bound").select("qid", "id", "dist")
    assert same(knn.within(q, v, 4)) == same(want)


@pytest.mark.parametrize("name", ["q_knn_exact", "q_knn_exact_filtered", "q_topk_rerank", "q_mips_topk", "q_dual_search_exact", "q_recall_ties", "q_rank_bounds", "q_worklist_merge", "q_scan_truth_dists", "q_adjacency_sorted"])
def test_queries_through_the_grid_equal_their_sql(spark, monkeypatch, name):
    monkeypatch.setattr(knn, "PAIRS", 0)
    monkeypatch.setattr("lodestone.plans.queries._ONCE", {})
    assert compare(connect(SF), QUERIES[name](spark, SF), ORACLE_SQL[name]) == ""


def test_pairs_of_large_tables_are_no_rows(spark):
    """Two tables of 4,000 vectors have 16 million pairs, which no join makes and no window sorts."""
    v = spark.range(4000).select("id", F.array(*(F.randn(i) for i in range(8))).alias("vec"))
    plan = graph.knn_graph(v, 8, 8)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan and "MapInArrow" in plan


def test_the_table_function_sends_single_precision_and_scans_in_parts(spark, monkeypatch):
    monkeypatch.setattr(knn, "TABLE_BYTES", 300 * (4 * 8 + 16))
    monkeypatch.setattr(knn, "SCAN", 7)
    rng = np.random.default_rng(5)
    v = spark.createDataFrame([(i, rng.integers(-1, 2, 8).astype(float).tolist()) for i in range(300)], "id bigint, vec array<double>")
    q = v.where("id < 9").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    knn.register_knn(spark, v, "near_parts")
    q.createOrReplaceTempView("asked_parts")
    for k in (1, 4, 500):
        found = spark.sql(f"SELECT a.qid, n.rk, n.id, n.dist FROM asked_parts a, LATERAL near_parts(a.qvec, {k}) n")
        assert same(found) == same(knn.knn(q, v, k))
    with pytest.raises(ValueError, match="one dimension"):
        knn.register_knn(spark, v.unionAll(spark.createDataFrame([(300, [1.0])], v.schema)))


def test_a_vector_without_an_estimate_hides_no_nearer_one(spark):
    """An infinite, a huge or a null vector in a batch is none of the k that bound the rest; lengths that single precision loses bound nothing."""
    v = spark.createDataFrame([(0, [math.inf, 0.0]), (1, [1e200, 0.0]), *((i, [float(i), 0.0]) for i in range(2, 40))], "id bigint, vec array<double>").coalesce(1)
    q = spark.createDataFrame([(0, [0.5, 0.0]), (1, [30.2, 1e-25]), (2, [1e19, 0.0])], "qid bigint, qvec array<double>")
    cell, x = knn.Cell(3, 2), np.array([r["vec"] for r in v.orderBy("id").collect()])
    cell.ask(np.arange(1), np.array([[0.5, 0.0]]), np.zeros(1, bool), np.full(1, math.nan))
    assert not list(cell.meet(np.arange(40), x, np.zeros(40, bool)))
    assert cell.answers()[1].tolist() == [2, 3, 4]
    for scale in (1.0, 1e-24, 1e-170):
        a, b = (df.withColumn(c, F.transform(c, lambda x, s=scale: x * s)) for df, c in ((q, "qvec"), (v, "vec")))
        for k in (2, 3, 6):
            assert same(knn.nearest(a, b, k, 2)) == same(knn.top(knn.distances(a, b, 2), "qid", k).select("qid", "rk", "id", "dist"))


def test_an_estimate_is_no_wider_than_single_precision():
    """Of 2,000 random vectors, few more than the k nearest are measured exactly."""
    rng = np.random.default_rng(3)
    q, v = rng.normal(size=(64, 16)), rng.normal(size=(2000, 16))
    cell, measured = knn.Cell(5, 16), []
    exact = cell._exact
    cell._exact = lambda i, j, v: measured.append(len(i)) or exact(i, j, v)
    cell.ask(np.arange(64), q, np.zeros(64, bool), np.full(64, math.nan))
    assert not list(cell.meet(np.arange(2000), v, np.zeros(2000, bool)))
    assert sum(measured) < 64 * 6 and cell.q_short.dtype == np.float32
    want = np.cumsum((q[:, None] - v) ** 2, axis=2)[..., -1]
    assert (cell.answers()[1].reshape(64, 5) == np.argsort(want, axis=1, kind="stable")[:, :5]).all()


@pytest.mark.parametrize("cell", [knn.CELL, 2000])
@pytest.mark.parametrize("k", [1, 5, 200])
def test_sums_of_a_grid_are_those_of_pairs(spark, monkeypatch, k, cell):
    """With null and NaN parts, repeated queries, keys that one side has not and sums that tie only to nine digits."""
    monkeypatch.setattr(knn, "CELL", cell)
    monkeypatch.setattr(knn, "TILE", 64)
    v, q = table(spark, 150, ""), table(spark, 40, "q")
    pivots = knn.pivots(v.where("id > 7"), 16, 2, 2)
    codes, asked = knn.encode(v, pivots, 2, 2), knn.distance_table(q.unionAll(q.where("qid % 9 = 4")), pivots, 2, 2)
    rows = [(i % 50, i % 2, (i * 7) % 13) for i in range(100)]
    other = spark.createDataFrame(rows, "id bigint, chunk int, code int"), spark.createDataFrame([(j, c, x, None if x == j else 0.1234567885 + (x * j % 7) * 1e-10) for j in range(5) for c in range(2) for x in range(11) if x != 2 * j], "qid bigint, chunk int, code int, d2 double")
    for a, b in ((codes, asked), other):
        assert same(knn.adc_top(a, b, k)) == same(knn.top(knn.adc(a, b), "qid", k).select("qid", "rk", "id", "dist"))
        assert knn.adc_top(a.limit(0), b, k).count() == 0 == knn.adc_top(a, b.limit(0), k).count()


@pytest.mark.parametrize("name", ["q_pq_adc_distance", "q_pq_rerank"])
def test_quantised_distances_of_large_tables_are_no_rows(spark, monkeypatch, name):
    """Pairs of a query and a vector are neither joined nor summed by a shuffle."""
    monkeypatch.setattr(knn, "adc", None)
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "sum(d2" not in plan
