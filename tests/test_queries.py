"""Every registered query: equal to its SQL where it has one, else held to invariants."""

from __future__ import annotations

import itertools

import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

import __spark_entry__
from lodestone.operators.events import SCENARIOS
from lodestone.plans import ORACLE_SQL, QUERIES
from lodestone.plans.queries import Fixture

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_names():
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLE_SQL) == {"q_generate_workload"}
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLE_SQL) <= set(__spark_entry__.oracle_sql())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["qid", "rk", "id", "dist"]


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    assert compare(con, QUERIES[name](spark, SF), ORACLE_SQL[name]) == ""


def check_graph(edges, ids, r=6):
    rows = edges.collect()
    degree: dict[int, int] = {}
    for e in rows:
        degree[e["src"]] = degree.get(e["src"], 0) + 1
    assert max(degree.values()) <= r
    assert all(e["src"] != e["dst"] for e in rows)
    assert {e["src"] for e in rows} | {e["dst"] for e in rows} <= ids
    assert len({(e["src"], e["dst"]) for e in rows}) == len(rows)


def test_built_graphs_hold_their_invariants(spark):
    f = Fixture(spark, SF)
    every = {r["id"] for r in f.v.collect()}
    dead = {r["id"] for r in f.dead.collect()}
    check_graph(QUERIES["q_build_graph"](spark, SF), every)
    check_graph(QUERIES["q_refine_graph"](spark, SF), every)
    check_graph(QUERIES["q_insert_batch"](spark, SF), every)
    check_graph(QUERIES["q_reinsert"](spark, SF), every)
    check_graph(QUERIES["q_consolidate"](spark, SF), every - dead)


def test_generated_workloads_are_valid(spark):
    df = QUERIES["q_generate_workload"](spark, SF)
    n = spark.read.parquet(f"{SF}/events.parquet").count()
    assert df.groupBy("scenario").count().where(F.col("count") == n).count() == 8
    for s in SCENARIOS:
        rows = df.where(F.col("scenario") == s.name).orderBy("seq").collect()
        live, given = set(), int(500 * s.base_init_ratio)
        assert [r["seq"] for r in rows] == list(range(1, n + 1)) and all(a["t"] < b["t"] for a, b in itertools.pairwise(rows))
        for r in rows:
            if r["type"] == "insert":
                assert r["id"] == given < 500
                given += 1
                live.add(r["id"])
            elif r["type"] == "delete":
                live.remove(r["id"])
            else:
                assert 0 <= r["id"] < 25
        assert sum(r["type"] == "insert" for r in rows) == min(int(n * s.insert_ratio), 500 - int(500 * s.base_init_ratio))


def test_the_exact_plan_limits_before_it_shuffles(spark):
    plan = QUERIES["q_knn_exact"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "CartesianProduct" not in plan and "Python" not in plan
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in plan
