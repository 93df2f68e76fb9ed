"""Event streams of inserts, deletes and queries: reading, checking, sampling, generating, replaying.

An event log has seq, t, type ('insert', 'delete', 'query'), id and, where it
matters, vec. Order is by (t, seq); seq is unique.
"""

from __future__ import annotations

import zlib
from collections import OrderedDict
from collections.abc import Callable, Sequence
from dataclasses import astuple, dataclass
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import l2sq, normalize
from lodestone.operators.knn import dimension, knn, top
from lodestone.operators.snapshot import materialize, numbered

TYPES = ("insert", "delete", "query")


@dataclass(frozen=True)
class Scenario:
    name: str
    insert_ratio: float
    delete_ratio: float
    query_ratio: float
    drift_sigma: float
    temporal_pattern: str
    drift_model: str
    deletion_policy: str
    query_distribution: str
    query_skew_alpha: float
    query_coupling: str
    batch_size: int
    locality_window: int
    base_init_ratio: float


# The eight preset scenarios.
SCENARIOS = (
    Scenario("e_commerce", 0.30, 0.05, 0.65, 0.02, "poisson", "gaussian", "fifo", "uniform", 0.0, "decoupled", 1, 100, 0.7),
    Scenario("social_burst", 0.50, 0.05, 0.45, 0.06, "burst_decay", "directional", "fifo", "zipfian", 1.2, "semi_coupled", 5, 200, 0.6),
    Scenario("news_indexing", 0.35, 0.25, 0.40, 0.08, "poisson", "cluster", "fifo", "uniform", 0.0, "decoupled", 1, 50, 0.65),
    Scenario("concurrent_mixed", 0.33, 0.33, 0.34, 0.03, "uniform", "gaussian", "random", "uniform", 0.0, "decoupled", 1, 100, 0.5),
    Scenario("distribution_shift", 0.40, 0.10, 0.50, 0.12, "poisson", "directional", "lru", "gaussian", 0.5, "semi_coupled", 10, 500, 0.6),
    Scenario("skewed_access", 0.25, 0.10, 0.65, 0.02, "poisson", "gaussian", "random", "zipfian", 1.5, "decoupled", 1, 100, 0.7),
    Scenario("adaptive_growth", 0.45, 0.05, 0.50, 0.03, "poisson", "gaussian", "random", "uniform", 0.0, "fully_coupled", 1, 300, 0.5),
    Scenario("locality_aware", 0.30, 0.10, 0.60, 0.04, "uniform", "gaussian", "lru", "uniform", 0.0, "fully_coupled", 1, 1000, 0.6),
)


def scenarios(spark: SparkSession) -> DataFrame:
    names = list(Scenario.__dataclass_fields__)
    kinds = {str: "string", float: "double", int: "int"}
    ddl = ", ".join(f"{n} {kinds[type(getattr(SCENARIOS[0], n))]}" for n in names)
    return spark.createDataFrame([tuple(getattr(s, n) for n in names) for s in SCENARIOS], ddl)


def scenario_sizes(vectors: DataFrame, events: DataFrame) -> DataFrame:
    """The presets with what a log of as many events over these vectors has: vectors at the start and in the pool, inserts (as many as the pool allows), deletes, queries."""
    n = vectors.agg(F.count("*").alias("n_vectors")).crossJoin(events.agg(F.count("*").alias("n_events")))  # single rows
    rows = scenarios(vectors.sparkSession).crossJoin(F.broadcast(n))  # eight rows
    share = lambda c: F.floor(F.col("n_events") * F.col(c))
    rows = rows.withColumn("n_base", F.floor(F.col("n_vectors") * F.col("base_init_ratio"))).withColumn("n_pool", F.col("n_vectors") - F.col("n_base"))
    return rows.withColumn("n_inserts", F.least(share("insert_ratio"), F.col("n_pool"))).withColumn("n_deletes", share("delete_ratio")).withColumn("n_queries", F.col("n_events") - share("insert_ratio") - share("delete_ratio"))


# ---- checking


def normalize_dialects(raw: DataFrame) -> DataFrame:
    """seq, type, t, id, vec of raw lines in either dialect (t/id/vec or timestamp/point_id/vector); header lines go, unknown types too."""
    has = set(raw.columns)
    pick = lambda *names: F.coalesce(*(F.col(n) for n in names if n in has), F.lit(None))
    return raw.where(F.col("type").isin(*TYPES)).select(
        "seq", "type", pick("t", "timestamp").cast("bigint").alias("t"), pick("id", "point_id", "query_id").cast("bigint").alias("id"), pick("vec", "vector").alias("vec")
    )


def bad_records(raw: DataFrame) -> DataFrame:
    """Lines of a type that is neither known nor a header."""
    return raw.where(F.col("type").isNull() | ~F.col("type").isin(*TYPES, "metadata"))


def valid(events: DataFrame) -> DataFrame:
    """Events that can be applied: inserts and queries need a vector."""
    return events.where("vec IS NOT NULL OR type = 'delete'")


def summary(events: DataFrame) -> DataFrame:
    """type, n, pct."""
    counts = events.groupBy("type").agg(F.count("*").alias("n"))
    return counts.select("type", "n", (F.col("n") * F.lit(100.0) / F.sum("n").over(Window.partitionBy())).alias("pct"))  # three rows


def violations(events: DataFrame) -> DataFrame:
    """One row of counts: time going back, unknown types, missing ids, deletes without an insert before."""
    before = F.lag("t").over(Window.partitionBy(F.floor(F.col("seq") / 65536)).orderBy("seq"))
    edges = events.withColumn("before", before)
    own = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    inserts = F.coalesce(F.sum(F.when(F.col("type") == "insert", 1).otherwise(0)).over(own), F.lit(0))
    rows = edges.withColumn("inserts", inserts)
    first = events.groupBy(F.floor(F.col("seq") / 65536).alias("b")).agg(F.min_by("t", "seq").alias("first"), F.max_by("t", "seq").alias("last"))
    seams = first.withColumn("prev", F.lag("last").over(Window.orderBy("b"))).agg(F.count_if(F.expr("first < prev")).alias("n_seams"))  # one row per 65536 events
    counts = rows.agg(
        F.count("*").alias("n"), F.count_if(F.expr("t < before")).alias("n_back"), F.count_if(~F.col("type").isin(*TYPES)).alias("n_type"),
        F.count_if(F.expr("id IS NULL")).alias("n_id"), F.count_if(F.expr("type = 'delete' AND inserts = 0")).alias("n_orphan_deletes"),
    )
    return counts.crossJoin(seams).select("n", (F.col("n_back") + F.col("n_seams")).alias("n_back"), "n_type", "n_id", "n_orphan_deletes")


def last_change(events: DataFrame, upto: Column | None = None) -> DataFrame:
    """id, type, seq of the last insert or delete of every id."""
    changes = events.where("type IN ('insert', 'delete')")
    changes = changes.where(upto) if upto is not None else changes
    return changes.groupBy("id").agg(F.max_by("type", F.struct("t", "seq")).alias("type"), F.max("seq").alias("seq"))


def live(events: DataFrame, upto: Column | None = None) -> DataFrame:
    """Ids whose last change is an insert."""
    return last_change(events, upto).where("type = 'insert'").select("id")


def ratio_stats(events: DataFrame) -> DataFrame:
    """One row: events, shares of the types, deletes of ids that were not live, and ids live at the end."""
    own = Window.partitionBy("id").orderBy("seq")
    changes = events.where("type IN ('insert', 'delete')").withColumn("before", F.lag("type").over(own))
    failed = changes.agg(F.count_if(F.expr("type = 'delete' AND coalesce(before, 'delete') = 'delete'")).alias("n_failed_deletes"))
    share = lambda t: (F.count_if(F.col("type") == t) / F.count("*")).alias(f"{t}_ratio")
    return events.agg(F.count("*").alias("n"), *map(share, TYPES)).crossJoin(failed).crossJoin(live(events).agg(F.count("*").alias("n_live")))  # single rows


# ---- replay


def intervals(events: DataFrame) -> DataFrame:
    """id, since, until: the seqs between which an insert is live; until is null where it lasts."""
    changes = events.where("type IN ('insert', 'delete')")
    return changes.withColumn("until", F.lead("seq").over(Window.partitionBy("id").orderBy("seq"))).where("type = 'insert'").select("id", F.col("seq").alias("since"), "until")


BLOCK, PART = 4096, 50_000  # events of a block; intervals that meet the queries of a block in one task, about


def temporal_knn(events: DataFrame, queries: DataFrame, vectors: DataFrame, k: int = 3) -> DataFrame:
    """seq, rk, id, dist: for every query event with a query vector, the k nearest of what is live at its place in the log.

    The log is cut into blocks; what is live at any time of a block meets the
    queries of that block alone, in parts by a hash of the id, so that no task
    gets more than about PART of them, and is then held against the queries'
    places within the block.
    """
    dim = dimension(vectors)
    place = lambda seq: F.floor(seq / BLOCK)
    asked = events.where("type = 'query'").select("seq", F.col("id").alias("qid")).join(queries, "qid").select("seq", "qvec", place(F.col("seq")).alias("block"))
    parts = -(-vectors.count() // PART) or 1
    last = events.agg(F.max("seq").alias("last"))
    spans = intervals(events).crossJoin(F.broadcast(last)).withColumn("end", F.coalesce("until", F.col("last") + 1)).where("end > since + 1")  # one row
    points = spans.join(vectors.select("id", "vec"), "id").select("id", "vec", "since", "end", F.explode(F.sequence(place(F.col("since") + 1), place(F.col("end") - 1))).alias("block"), F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"))
    each = asked.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))
    pairs = points.join(each, ["block", "part"]).where("since < seq AND seq < end")
    near = pairs.select("seq", "id", l2sq(F.col("qvec"), F.col("vec"), dim).alias("dist"))
    return top(near, "seq", k).select("seq", "rk", "id", "dist")


# ---- sampling and generating


def uniform_clock(events: DataFrame) -> DataFrame:
    """seq, t: one tick for every event before and including it."""
    block = F.floor((F.col("seq") - 1) / 65536)
    within = F.count("*").over(Window.partitionBy(block).orderBy("seq"))
    before = events.groupBy(block.alias("b")).agg(F.count("*").alias("n")).withColumn("base", F.sum("n").over(Window.orderBy("b")) - F.col("n"))  # one row per 65536 events
    return events.withColumn("b", block).withColumn("w", within).join(before, "b").select("seq", (F.col("base") + F.col("w")).alias("t"))


def decay_intervals(events: DataFrame, phase: int = 500, rate: float = 0.9) -> DataFrame:
    """seq, wait: the waits that events of the decay phases of a log would have; these follow burst phases of the same length."""
    at = F.col("seq") - 1
    wait = F.greatest(F.lit(1), F.floor(F.lit(10.0) / (F.pow(F.lit(rate), (at % phase).cast("double")) + F.lit(0.1))).cast("int"))
    return events.where(F.floor(at / phase) % 2 == 1).select("seq", wait.alias("wait"))


def drift(vectors: DataFrame, model: str, sigma: float, centers: DataFrame | None = None, direction: list[float] | None = None, seed: int = 7) -> DataFrame:
    """Vectors moved by noise, along a direction, or by their cluster's center (label, center), then at unit length."""
    dim = dimension(vectors)
    if model == "cluster":
        moved = vectors.join(F.broadcast(centers), "label").withColumn("vec", F.zip_with("vec", "center", lambda a, b: a + b)).drop("center")  # a row per label
    elif model == "directional":
        along = F.array(*map(F.lit, direction))
        moved = vectors.withColumn("u", F.rand(seed) * sigma).withColumn("vec", F.zip_with("vec", along, lambda a, b: a + F.col("u") * b)).drop("u")
    else:
        noise = F.array(*(F.randn(seed + i) * sigma for i in range(dim or 1)))
        moved = vectors.withColumn("noise", noise).withColumn("vec", F.zip_with("vec", "noise", lambda a, b: a + b)).drop("noise")
    return moved.withColumn("vec", normalize(F.col("vec")))  # a computed vector is folded, not unrolled, so that it is made twice only


def victims(events: DataFrame) -> DataFrame:
    """policy, id: what each deletion policy would delete after the log; random is left to the generator."""
    alive = live(events)
    born = events.where("type = 'insert'").groupBy("id").agg(F.max("seq").alias("born"))
    asked = events.where("type = 'query'").groupBy("id").agg(F.max("seq").alias("asked"))
    rows = alive.join(born, "id").join(asked, "id", "left").withColumn("used", F.greatest("born", F.coalesce("asked", "born")))
    best = rows.agg(F.min_by("id", "born").alias("fifo"), F.min_by("id", "used").alias("lru"), F.min("id").alias("clustered_low"), F.max("id").alias("clustered_high"))
    return best.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, best.columns)), F.array(*best.columns))).alias("policy", "id"))


def zipf_cdf(queries: DataFrame, alpha: float = 1.2) -> DataFrame:
    """qid, i, p, cdf of a Zipf distribution over queries (qid), ranked by qid; summed by blocks of ranks."""
    ranks = numbered(queries.select("qid"), "qid", column="i").withColumn("w", F.pow(F.col("i").cast("double"), F.lit(-alpha))).withColumn("b", F.floor(F.col("i") / 65536))
    sums = ranks.groupBy("b").agg(F.sum("w").alias("s"))  # one row for 65,536 queries
    before = sums.select("b", (F.sum("s").over(Window.orderBy("b")) - F.col("s")).alias("before"), F.sum("s").over(Window.partitionBy()).alias("total"))
    so_far = F.sum("w").over(Window.partitionBy("b").orderBy("i"))
    return ranks.withColumn("c", so_far).join(F.broadcast(before), "b").select("qid", "i", F.round(F.col("w") / F.col("total"), 9).alias("p"), F.round((F.col("before") + F.col("c")) / F.col("total"), 9).alias("cdf"))


def recent_inserts(events: DataFrame, n: int = 10) -> DataFrame:
    """seq, id of the last n inserts."""
    return events.where("type = 'insert'").orderBy(F.desc("seq")).limit(n).select("seq", "id")


MADE = "scenario string, seq bigint, t bigint, type string, id bigint, near boolean"
MADE_BLOCK = 1 << 16  # events that a task draws at a time


def _rng(seed: int, s: Scenario, *what: int) -> np.random.Generator:
    return np.random.default_rng([seed, zlib.crc32(s.name.encode()), *what])


def _waits(rng: np.random.Generator, pattern: str, i: np.ndarray) -> np.ndarray:
    """Ticks before the events of the places i."""
    if pattern == "poisson":
        return np.maximum(rng.poisson(2.0, len(i)), 1)
    if pattern == "burst_decay":  # phases of 500 events, by turns
        slow = np.maximum((10 / (0.9 ** (i % 500) + 0.1)).astype(np.int64), 1)
        return np.where(i // 500 % 2 == 0, rng.integers(1, 5, len(i)), slow)
    return np.ones(len(i), np.int64)


@lru_cache(2)
def _zipf(alpha: float, size: int) -> np.ndarray:
    weight = np.arange(1, size + 1, dtype=np.float64) ** -alpha
    return np.cumsum(weight) / weight.sum()


def _asked(rng: np.random.Generator, distribution: str, alpha: float, n: int, size: int) -> np.ndarray:
    """Numbers of queries below size."""
    if distribution == "zipfian":
        return np.minimum(np.searchsorted(_zipf(alpha, size), rng.random(n), side="right"), size - 1)
    if distribution == "gaussian":
        return np.clip(rng.normal(0.5 * size, 0.2 * size, n).astype(np.int64), 0, size - 1)
    return rng.integers(0, size, n)


class Live:
    """Ids that a deletion policy can take: each operation in constant time."""

    def __init__(self, policy: str, rng: np.random.Generator):
        self.policy, self.rng = policy, rng
        self.order: OrderedDict[int, None] = OrderedDict()  # by insertion; for lru by last use
        self.listed: list[int] = []
        self.place: dict[int, int] = {}

    def __len__(self) -> int:
        return len(self.order)

    def insert(self, i: int) -> None:
        self.order[i] = None
        self.place[i] = len(self.listed)
        self.listed.append(i)

    def use(self, i: int) -> None:
        if self.policy == "lru" and i in self.order:
            self.order.move_to_end(i)

    def take(self) -> int:
        """The id to delete: the oldest (fifo), the least lately used (lru), the lowest or highest (clustered; ids rise), or any (random)."""
        if self.policy == "random":
            i = self.listed[int(self.rng.integers(len(self.listed)))]
        else:
            i = next(iter(self.order)) if self.policy in ("fifo", "lru") or self.rng.random() < 0.5 else next(reversed(self.order))
        del self.order[i]
        at, last = self.place.pop(i), self.listed.pop()
        if last != i:
            self.listed[at], self.place[last] = last, at
        return i


@dataclass
class Block:
    """Consecutive events of a scenario, and what was before them: inserts drawn and made, ids live, the time."""

    scenario: int
    block: int
    start: int
    n: int
    n_insert: int
    n_delete: int
    drawn: int
    given: int = 0
    live: int = 0
    t: int = 0


PLAN = ", ".join(f"{x} bigint" for x in Block.__dataclass_fields__)
SUMS = "scenario bigint, block bigint, ticks bigint, change bigint, least bigint"
CHANGES = "scenario bigint, seq bigint, t bigint, kind bigint, id bigint"  # 0: insert, 1: delete, 2: use
ROWS = "scenario bigint, seq bigint, t bigint, kind bigint, id bigint, near boolean"


def _blocks(which: int, s: Scenario, n: int, seed: int) -> list[Block]:
    """The blocks of a scenario; its exact numbers of kinds are dealt to them as a shuffle of all events would."""
    rng, left = _rng(seed, s, 0), np.array([int(n * s.insert_ratio), int(n * s.delete_ratio), 0])
    left[2], out, drawn = n - left.sum(), [], 0
    for at in range(0, n, MADE_BLOCK):
        size = min(MADE_BLOCK, n - at)
        n_insert = int(rng.hypergeometric(left[0], left[1] + left[2], size))
        n_delete = int(rng.hypergeometric(left[1], left[2], size - n_insert)) if size > n_insert and left[1] + left[2] else 0
        out.append(Block(which, at // MADE_BLOCK, at, size, n_insert, n_delete, drawn))
        left -= [n_insert, n_delete, size - n_insert - n_delete]
        drawn += n_insert
    return out


def _drawn(s: Scenario, b: Block, pool: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of a block's events, the ticks before them, which of them insert, and the changes of the live set, each delete counted."""
    i = b.start + np.arange(b.n)
    kinds = np.full(b.n, 2)
    kinds[: b.n_insert], kinds[b.n_insert : b.n_insert + b.n_delete] = 0, 1
    _rng(seed, s, 1, b.block).shuffle(kinds)
    inserts = (kinds == 0) & (b.drawn + np.cumsum(kinds == 0) <= pool)
    return i, _waits(_rng(seed, s, 2, b.block), s.temporal_pattern, i), inserts, inserts.astype(np.int64) - (kinds == 1)


def _sums(s: Scenario, b: Block, pool: int, seed: int) -> tuple[int, int, int, int, int]:
    _, waits, _, change = _drawn(s, b, pool, seed)
    so_far = np.cumsum(change)
    return b.scenario, b.block, int(waits.sum()), int(so_far[-1]), min(0, int(so_far.min()))


def _begin(blocks: list[Block], sums: dict[tuple[int, int], tuple[int, int, int]], pools: list[int]) -> None:
    """Set what is before every block; a delete of nothing changes nothing."""
    for before, b in zip([None, *blocks], blocks):
        if before is not None and before.scenario == b.scenario:
            ticks, change, least = sums[before.scenario, before.block]
            b.t, b.live = before.t + ticks, before.live + change + max(0, -(before.live + least))
        b.given = min(b.drawn, pools[b.scenario])


def _events(s: Scenario, b: Block, first: int, pool: int, n_queries: int, seed: int) -> pd.DataFrame:
    """The events of a block as ROWS; ids of deletes are right for fifo alone."""
    i, waits, inserts, change = _drawn(s, b, pool, seed)
    idle = np.maximum.accumulate(np.maximum(-(b.live + np.cumsum(change)), 0))  # deletes of nothing, so far
    deletes = (change < 0) & (np.diff(idle, prepend=0) == 0)
    given = b.given + np.cumsum(inserts)
    rng = _rng(seed, s, 3, b.block)
    asked, chance, pick = _asked(rng, s.query_distribution, s.query_skew_alpha, b.n, max(n_queries, 1)), rng.random(b.n), rng.random(b.n)
    share = {"decoupled": 0.0, "semi_coupled": 0.3, "fully_coupled": 1.0}[s.query_coupling]
    near = ~inserts & ~deletes & (given > 0) & (chance < share)
    last = first + given - 1
    ids = np.where(near, last - (pick * np.minimum(given, s.locality_window)).astype(np.int64), asked)
    ids = np.where(inserts, last, np.where(deletes, first + b.given - b.live + np.cumsum(deletes) - 1, ids))
    kind = np.where(inserts, 0, np.where(deletes, 1, 2))
    return pd.DataFrame({"scenario": b.scenario, "seq": i + 1, "t": b.t + np.cumsum(waits), "kind": kind, "id": ids, "near": near})


def _changes(s: Scenario, rows: pd.DataFrame) -> pd.DataFrame:
    """Of a block's events what the deletion policy has to see; of the uses of an id between two deletes the last."""
    rows = rows[(rows["kind"] != 2) | (rows["near"] & (s.deletion_policy == "lru"))]
    gap = (rows["kind"] == 1).cumsum()
    again = pd.DataFrame({"gap": gap, "id": rows["id"]})[rows["kind"] == 2].duplicated(keep="last")
    return rows.drop(index=again.index[again]).drop(columns="near")


def _victims(batches, by: Sequence[Scenario], seed: int):
    """The deletes of CHANGES that come in order of scenario and seq, with their ids; what is held is the live set."""
    which = None
    for rows in batches:
        out = []
        for scenario, seq, t, kind, i in zip(*(rows[c].tolist() for c in ("scenario", "seq", "t", "kind", "id"))):
            if scenario != which:
                which, live = scenario, Live(by[scenario].deletion_policy, _rng(seed, by[scenario], 4))
            if kind == 0:
                live.insert(i)
            elif kind == 1:
                out.append((scenario, seq, t, 1, live.take(), False))
            else:
                live.use(i)
        yield pd.DataFrame(out, columns=["scenario", "seq", "t", "kind", "id", "near"])


def _play(s: Scenario, n: int, n_base: int, n_queries: int, seed: int) -> pd.DataFrame:
    """One scenario, played here."""
    first = int(n_base * s.base_init_ratio)
    blocks, pool = _blocks(0, s, n, seed), n_base - first
    sums = [_sums(s, b, pool, seed) for b in blocks]
    _begin(blocks, {x[:2]: x[2:] for x in sums}, [pool])
    rows = pd.concat([_events(s, b, first, pool, n_queries, seed) for b in blocks], ignore_index=True)
    rows.loc[rows["kind"] == 1, "id"] = pd.concat(_victims([_changes(s, rows)], [s], seed))["id"].to_numpy(np.int64)
    rows["scenario"], rows["type"] = s.name, np.array(TYPES, object)[rows["kind"]]
    return rows[["scenario", "seq", "t", "type", "id", "near"]]


def generate(spark: SparkSession, scenarios: Sequence[Scenario], n: int, n_base: int, n_queries: int, seed: int = 7) -> DataFrame:
    """Event logs (scenario, seq, t, type, id, near) of n events for each scenario, each delete of an id that is live.

    Kinds are drawn in the scenario's exact numbers and shuffled. Inserts take
    the ids of the base vectors after the initial share, in order, until there
    are no more; what cannot be inserted or deleted becomes a query. A query's id
    is the number of a query vector, drawn from the scenario's distribution, or,
    where near is set, one of the last locality_window inserts, whose nearest
    query is meant (see coupled); such a query counts as a use for lru.

    Tasks draw blocks of MADE_BLOCK events, each from a seed of its own; the
    driver adds up one row for each. Which id a delete takes, other than by fifo,
    depends on all before it: the inserts and deletes of a scenario, at most two
    for each base vector, and for lru the uses up to its last delete, stream
    through one task.
    """
    by = list({s.name: s for s in scenarios}.values())
    firsts = [int(n_base * s.base_init_ratio) for s in by]
    pools = [n_base - x for x in firsts]
    blocks = [b for i, s in enumerate(by) for b in _blocks(i, s, n, seed)]

    def each(make: Callable[[Scenario, Block, int, int], pd.DataFrame]) -> Callable:
        def run(batches):
            for batch in batches:
                for row in batch.itertuples(index=False):
                    b = Block(*map(int, row))
                    yield make(by[b.scenario], b, firsts[b.scenario], pools[b.scenario])

        return run

    def plan(some: list[Block]) -> DataFrame:
        parts = min(len(some), 4 * spark.sparkContext.defaultParallelism) or 1
        return spark.createDataFrame([astuple(b) for b in some], PLAN).repartition(parts, "scenario", "block")

    names = SUMS.replace(" bigint", "").split(", ")
    sums = plan(blocks).mapInPandas(each(lambda s, b, _, pool: pd.DataFrame([_sums(s, b, pool, seed)], columns=names)), SUMS).collect()  # one row for each block
    _begin(blocks, {tuple(x[:2]): tuple(x[2:]) for x in sums}, pools)
    fifo = [s.deletion_policy == "fifo" for s in by]

    def rows(s: Scenario, b: Block, first: int, pool: int) -> pd.DataFrame:
        made = _events(s, b, first, pool, n_queries, seed)
        return made if fifo[b.scenario] else made[made["kind"] != 1]

    queued = [b for b in blocks if not fifo[b.scenario] and (b.live or b.drawn < pools[b.scenario])]  # elsewhere nothing is live
    seen = plan(queued).mapInPandas(each(lambda s, b, first, pool: _changes(s, _events(s, b, first, pool, n_queries, seed))), CHANGES)
    taken = seen.repartition("scenario").sortWithinPartitions("scenario", "seq").mapInPandas(lambda batches: _victims(batches, by, seed), ROWS)
    named = lambda names, c: F.element_at(F.array(*map(F.lit, names)), (F.col(c) + 1).cast("int"))
    made = plan(blocks).mapInPandas(each(rows), ROWS).unionByName(taken)
    return made.select(named([s.name for s in by], "scenario").alias("scenario"), "seq", "t", named(TYPES, "kind").alias("type"), "id", "near")


NEAREST_BYTES = 64 << 20  # of answers that go to every task, at most


def coupled(events: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """events with near resolved: the id of the query vector (id, vec) that is nearest to the insert's vector.

    Many events are near one of a few inserts: the answers go to the tasks while
    they are within NEAREST_BYTES.
    """
    events = materialize(events)
    inserts = events.where("near").select("id").distinct().join(vectors, "id").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    nearest = materialize(knn(inserts, queries, 1).select(F.col("qid").alias("insert"), F.col("id").alias("query")))
    nearest = F.broadcast(nearest) if nearest.count() * 16 <= NEAREST_BYTES else nearest
    asked = events.withColumn("insert", F.when(F.col("near"), F.col("id"))).join(nearest, "insert", "left")
    return asked.select("scenario", "seq", "t", "type", F.when(F.col("near"), F.col("query")).otherwise(F.col("id")).alias("id"))


def with_vectors(events: DataFrame, vectors: DataFrame, queries: DataFrame, scenario: Scenario, **how) -> DataFrame:
    """events of one scenario with vec: of inserts the drifted base vector, of queries the query vector; tables (id, vec) and, for cluster drift, label."""
    moved = drift(vectors, scenario.drift_model, scenario.drift_sigma, **how) if scenario.drift_sigma > 0 else vectors
    both = moved.select("id", "vec", F.lit("insert").alias("type")).unionByName(queries.select("id", "vec", F.lit("query").alias("type")))
    return events.join(both, ["id", "type"], "left").select("scenario", "seq", "t", "type", "id", "vec")


def fixed_mix(queries: DataFrame, inserts: DataFrame, deletes: DataFrame, tick: int = 10) -> DataFrame:
    """seq, t, type, id: each of the given ids (id) once as an event of its kind, shuffled by a multiplicative hash, one every tick from 0."""
    parts = [df.select(F.lit(kind).alias("type"), F.col("id").cast("bigint").alias("id"), (F.col("id") * 3 + i).alias("k")) for i, (kind, df) in enumerate((("query", queries), ("insert", inserts), ("delete", deletes)))]
    rows = reduce(DataFrame.unionByName, parts).withColumn("h", F.pmod(F.col("k") * 2654435761, F.lit(1 << 32)))
    return numbered(rows, "h", "k").select("seq", ((F.col("seq") - 1) * tick).alias("t"), "type", "id")
