"""Connected components of large undirected graphs, by rounds of joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.runtime import discard, materialize


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (root, node) that connect the same nodes as the edges (a, b); each root is the least of its tree."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    root = np.array([find(i) for i in range(len(nodes))], np.int64)
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[child]], nodes[child]


def _shrink(batches):
    """Forests of batches of edges, merged while they are small."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flush():
        a, b = forest(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
        for i in range(0, len(a), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[i : i + 50_000]), pa.array(b[i : i + 50_000])], names=["a", "b"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size > 1_000_000:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def components(edges: DataFrame) -> DataFrame:
    """node and component, the least node reachable, for every node of edges (a, b: bigint).

    Nodes without a partner may be absent. Large-star and small-star rounds: each
    node's partners move to its least one, until nothing changes. Edges that a
    task can contract on its own go first, and every round is a written table.
    """
    edges = edges.select("a", "b").where("a <> b")
    now = materialize(edges.mapInArrow(_shrink, "a bigint, b bigint").distinct())
    while True:
        # large star: larger partners of a node move to its least partner
        both = now.select("a", "b").unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # small star: a node and its smaller partners move to the least of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b")
        small = small.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b").distinct()
        after = materialize(small)
        same = lambda t: t.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if same(after) == same(now):
            discard(after)
            break
        discard(now)
        now = after
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionAll(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
