"""Recall against ground truth, latency and index statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def recall(truth: DataFrame, found: DataFrame, ks: tuple[int, ...] = (10,)) -> DataFrame:
    """k, recall in percent: shared ids of the first k of both, over all queries of truth; tables (qid, rk, id)."""
    queries = truth.agg(F.countDistinct("qid").alias("q"))
    hits = truth.select("qid", "id", "rk").join(found.select("qid", "id", F.col("rk").alias("frk")), ["qid", "id"])
    counts = hits.agg(*(F.count_if((F.col("rk") <= k) & (F.col("frk") <= k)).alias(f"n{k}") for k in ks))
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), (F.col(f"n{k}") * F.lit(100.0) / (F.col("q") * k)).alias("recall")) for k in ks)))
    return queries.crossJoin(counts).select(rows.alias("r")).select("r.*")  # two single rows


def recall_per_query(truth: DataFrame, found: DataFrame, k: int = 10) -> DataFrame:
    """qid, recall in percent; an id that is found twice counts once."""
    best = found.where(F.col("rk") <= k).select("qid", "id").distinct().withColumn("hit", F.lit(1))
    hits = truth.where(F.col("rk") <= k).select("qid", "id").join(best, ["qid", "id"], "left")
    return hits.groupBy("qid").agg((F.count("hit") * F.lit(100.0) / k).alias("recall"))


def recall_ties(distances: DataFrame, found: DataFrame, k: int = 10) -> DataFrame:
    """recall in percent where the truth also holds all that tie with its k-th; distances (qid, id, dist), found (qid, id)."""
    truth = distances.withColumn("rank", F.rank().over(Window.partitionBy("qid").orderBy("dist"))).where(F.col("rank") <= k)
    queries = distances.agg(F.countDistinct("qid").alias("q"))
    hits = truth.select("qid", "id").join(found.select("qid", "id"), ["qid", "id"]).agg(F.count("*").alias("n"))
    return queries.crossJoin(hits).select((F.col("n") * F.lit(100.0) / (F.col("q") * k)).alias("recall"))  # two single rows


def latency(events: DataFrame, by: str = "type", value: str = "value") -> DataFrame:
    """n, total, avg, p50, p99 and throughput per second of value, in ms, by group."""
    v = F.col(value)
    return events.groupBy(by).agg(
        F.count(v).alias("n"), F.round(F.sum(v), 4).alias("total"), F.round(F.avg(v), 6).alias("avg"),
        F.round(F.percentile(v, 0.5), 6).alias("p50"), F.round(F.percentile(v, 0.99), 6).alias("p99"), F.round(F.count(v) / F.sum(v) * 1000.0, 6).alias("qps"),
    )


def index_stats(vectors: DataFrame, fresh: DataFrame, tombstones: DataFrame, capacity: float = 0.1) -> DataFrame:
    """One row: sizes, live vectors, and shares in percent of the capacity used and of vectors deleted."""
    rows = vectors.select("id").join(fresh.select("id", F.lit(1).alias("f")), "id", "left").join(tombstones.select("id", F.lit(1).alias("d")), "id", "left")
    sums = rows.agg(F.count("*").alias("n"), F.count("f").alias("n_fresh"), F.count("d").alias("n_deleted"))
    return sums.select(
        (F.col("n") - F.col("n_fresh")).alias("n_static"), "n_fresh", "n_deleted", (F.col("n") - F.col("n_deleted")).alias("n_active"),
        (F.col("n_deleted") * F.lit(100.0) / F.col("n")).alias("pct_deleted"), (F.col("n_fresh") * F.lit(100.0) / F.floor((F.col("n") - F.col("n_fresh")) * capacity)).alias("pct_full"),
    )
