"""An index that is searched by its graph while a stream changes it."""

from __future__ import annotations

import json
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators import events as ev
from lodestone.operators import graph, snapshot
from lodestone.operators.graph import KEPT, _lists, _squares, greedy_kernel, keep, select
from lodestone.operators.snapshot import delete, materialize

CHANGES = "id bigint, kind string, vec array<double>, epoch bigint"
LISTS = "src bigint, ord int, dst bigint, dist double, epoch bigint"


class View:
    """Base graph and overlay as one graph of places: those of the base, then those of the vectors that came since.

    base: ids (sorted), vecs, lists of places. over: ids (sorted), vecs, epochs of
    new vectors; lists (src to the ids of its partners and its epoch); gone ids. A
    list counts for vectors that are not younger than it, so that what led to a
    vector that has been replaced leads nowhere.
    """

    def __init__(self, base: tuple, over: tuple):
        self.ids, self.vecs, self.base = base
        self.new, self.new_vecs, since, lists, gone = over
        n = len(self.ids)
        self.every = np.concatenate([self.ids, self.new])
        at, there = _find(self.ids, self.new)
        self.hidden = np.zeros(len(self.every), bool)
        self.hidden[at[there]] = True
        self.some_hidden = bool(there.any())
        self.gone = np.zeros(len(self.every), bool)
        place, known = self.place(gone)
        self.gone[place[known]] = True
        born = dict(zip(self.new.tolist(), since.tolist()))
        self.lists: dict[int, np.ndarray] = {}
        for src, (epoch, dst) in lists.items():
            if epoch >= born.get(src, epoch):
                place, known = self.place(np.array([d for d in dst if epoch >= born.get(d, epoch)], np.int64))
                self.lists[int(self.place(np.array([src]))[0][0])] = np.sort(place[known])
        self.n = n

    def place(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ids, and whether they have one."""
        a, in_new = _find(self.new, ids)
        b, in_base = _find(self.ids, ids)
        return np.where(in_new, a + len(self.ids), b), in_new | in_base

    def __getitem__(self, place: int) -> np.ndarray:
        found = self.lists.get(place)
        if found is not None:
            return found
        if place >= self.n:
            return np.zeros(0, np.int64)
        found = self.base[place]
        return found[~self.hidden[found]] if self.some_hidden else found

    def vectors(self, places: np.ndarray) -> np.ndarray:
        old = places < self.n
        if old.all():
            return self.vecs[places]
        out = np.zeros((len(places), self.new_vecs.shape[1]))
        out[old], out[~old] = self.vecs[places[old]] if old.any() else 0, self.new_vecs[places[~old] - self.n]
        return out

    def walk(self, q: np.ndarray, start: int, beam: int, gone: np.ndarray):
        at, known = self.place(np.array([start]))
        if not known[0]:
            return [], [], 0
        return greedy_kernel(lambda n: _squares(self.vectors(n), q), self, self.every, int(at[0]), beam, gone)


def _find(ids: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(ids, asked), max(len(ids) - 1, 0))
    return at, (ids[at] == asked) if len(ids) else np.zeros(len(asked), bool)


class GraphIndex:
    """A graph over vectors under root that batches of events change and ask.

    A segment is a whole graph (vectors, edges), which the tasks keep from batch
    to batch. A batch writes only what it changes: vectors that came or left, and
    the edge lists of nodes that are new or were linked back, pruned. It reads
    what was written since the segment, so its cost follows the batch and these
    changes, not the index. When deletes reach threshold of all vectors, or what
    came share of them, the graph is repaired (graph.consolidate) and written as
    the next segment; the same at once where the changes do not fit in a
    broadcast, or the index does not, which then is walked by joins.

    Within a batch the last change of an id, by (t, seq), decides; inserts and
    queries without a vector are no events. An insert of a known id replaces its
    vector. New vectors are linked to what was live before the batch, and queries
    see the graph after it. A batch that comes twice leaves the same state.
    """

    def __init__(self, spark: SparkSession, root: str, vectors: DataFrame | None = None, edges: DataFrame | None = None, threshold: float = 0.05, share: float = 0.1, k: int = 10, beam: int = 24, r: int = 6, alpha: float = graph.ALPHA):
        """An index of vectors (id, vec), with edges or a graph that is built, or without vectors the one that is there under root."""
        self.spark, self.root, self.threshold, self.share, self.k, self.beam, self.r, self.alpha = spark, root, threshold, share, k, beam, r, alpha
        self.sent: tuple[str, object] | None = None  # the segment that the tasks have
        self.passing: list = []  # what they have for the batch that runs
        if vectors is None:
            found = self._states()
            if not found:
                raise ValueError(f"no index under {root}")
            self.epoch = max(found)
            return
        delete(spark, root)
        self.epoch = 0
        self._segment(0, vectors, edges)

    # ---- state

    def _states(self) -> list[int]:
        return [int(n[6:]) for n in snapshot._names(self.spark, f"{self.root}/states") if n.startswith("state=")]

    def state(self, epoch: int) -> dict:
        return json.loads(snapshot._text(self.spark, f"{self.root}/states/state={epoch}"))

    def _put(self, epoch: int, **state) -> None:
        delete(self.spark, f"{self.root}/states/state={epoch}")
        snapshot._claim(self.spark, f"{self.root}/states/state={epoch}", json.dumps(state))

    def _segment(self, epoch: int, vectors: DataFrame, edges: DataFrame | None) -> None:
        """Write a graph as the segment that the state of epoch is."""
        name = f"segment={epoch}-{uuid.uuid4().hex}"
        graph.one_each(vectors).write.parquet(f"{self.root}/{name}/vectors")
        vectors = self.spark.read.parquet(f"{self.root}/{name}/vectors")
        edges = graph.build(vectors, None, self.r, self.alpha, self.beam, 0) if edges is None else edges
        edges.select("src", F.col("ord").cast("int").alias("ord"), "dst", "dist").write.parquet(f"{self.root}/{name}/edges")
        n = vectors.count()
        self._put(epoch, segment=name, since=epoch, n=n, start=graph.medoid(vectors) if n else None)

    def _base(self, state: dict) -> tuple[DataFrame, DataFrame]:
        at = f"{self.root}/{state['segment']}"
        return self.spark.read.schema("id bigint, vec array<double>").parquet(f"{at}/vectors"), self.spark.read.schema("src bigint, ord int, dst bigint, dist double").parquet(f"{at}/edges")

    def _deltas(self, state: dict, epoch: int) -> tuple[DataFrame, DataFrame]:
        """Changes and edge lists written since the segment, up to epoch; of each list the last."""
        there = range(state["since"] + 1, epoch + 1)
        tables = []
        for name, schema in (("changes", CHANGES), ("lists", LISTS)):
            paths = [f"{self.root}/delta={e}/{name}" for e in there]
            tables.append(self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema))
        changes, lists = tables
        last = F.max("epoch").over(Window.partitionBy("src"))
        return changes, lists.withColumn("last", last).where("epoch = last").drop("last")

    def tables(self, epoch: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """vectors (id, vec), edges (src, ord, dst, dist) and tombstones (id) as they are after the last batch, or were."""
        epoch = self.epoch if epoch is None else epoch
        state = self.state(epoch)
        vectors, edges = self._base(state)
        changes, lists = self._deltas(state, epoch)
        came = changes.where("kind = 'insert'").groupBy("id").agg(F.max_by(F.struct("vec", "epoch"), "epoch").alias("x")).select("id", "x.vec", F.col("x.epoch").alias("born"))
        gone = changes.groupBy("id").agg(F.max_by("kind", "epoch").alias("kind")).where("kind = 'delete'").select("id")
        src, dst = (came.select(F.col("id").alias(c), F.col("born").alias(f"{c}_born")) for c in ("src", "dst"))
        old = edges.join(lists.select("src").distinct(), "src", "left_anti").join(src, "src", "left_anti").join(dst, "dst", "left_anti")
        new = lists.where("dst IS NOT NULL").join(src, "src", "left").join(dst, "dst", "left").where("epoch >= coalesce(src_born, epoch) AND epoch >= coalesce(dst_born, epoch)")
        columns = ("src", "ord", "dst", "dist")
        return vectors.join(came, "id", "left_anti").unionByName(came.select("id", "vec")), old.select(*columns).unionByName(new.select(*columns)), gone

    # ---- batches

    def _resident(self, state: dict):
        """The segment as the tasks have it; sent once."""
        if self.sent is None or self.sent[0] != state["segment"]:
            vectors, edges = self._base(state)
            table = vectors.toPandas().sort_values("id")  # within GRAPH_BYTES, as fits has said
            ids = table["id"].to_numpy(np.int64)
            vecs = np.stack(table["vec"].to_numpy()) if len(ids) else np.zeros((0, 1))
            if self.sent is not None:
                self.sent[1].destroy()
            self.sent = state["segment"], self.spark.sparkContext.broadcast((ids, vecs, _lists(edges, ids)))
        return self.sent[1]

    def _send(self, value):
        """Broadcast for the batch that runs."""
        self.passing.append(self.spark.sparkContext.broadcast(value))
        return self.passing[-1]

    def _overlay(self, state: dict, epoch: int) -> tuple:
        """What came since the segment, for a View; within share of the index, or a segment would have been written."""
        changes, lists = self._deltas(state, epoch)
        came = changes.where("kind = 'insert'").groupBy("id").agg(F.max_by(F.struct("vec", "epoch"), "epoch").alias("x")).select("id", "x.*").toPandas().sort_values("id")
        gone = changes.groupBy("id").agg(F.max_by("kind", "epoch").alias("kind")).where("kind = 'delete'").toPandas()["id"].to_numpy(np.int64)
        rows = lists.groupBy("src").agg(F.max("epoch").alias("epoch"), F.collect_list("dst").alias("dst")).toPandas()  # r partners of each
        ids = came["id"].to_numpy(np.int64)
        vecs = np.stack(came["vec"].to_numpy()) if len(ids) else np.zeros((0, 1))
        return ids, vecs, came["epoch"].to_numpy(np.int64), {int(s): (int(e), list(d)) for s, e, d in zip(rows["src"], rows["epoch"], rows["dst"])}, gone

    def _fits(self, state: dict, changed: int) -> bool:
        vectors, _ = self._base(state)
        width = 8 * (graph.dimension(vectors) or 1) + 8 + 24 * self.r
        return (state["n"] + changed) * width <= graph.GRAPH_BYTES

    def apply(self, batch: DataFrame, epoch: int) -> None:
        """One micro-batch of (seq, t, type, id, vec), upon the state numbered epoch."""
        state = self.state(epoch)
        self.epoch = epoch
        valid = materialize(ev.valid(batch).where(F.col("type").isin(*ev.TYPES)).select("seq", "t", "type", "id", "vec"))
        last = materialize(valid.where("type <> 'query' AND id IS NOT NULL").groupBy("id").agg(F.max_by(F.struct("type", "vec"), F.struct("t", "seq")).alias("x")).select("id", "x.type", "x.vec"))
        queries = valid.where("type = 'query'").select(F.col("seq").alias("qid"), F.col("vec").alias("qvec"))
        n_last = last.count()
        if state["start"] is not None and self._fits(state, n_last):
            n = self._change(state, epoch, last)
            found = self._ask(state, epoch + 1, queries)
        else:
            n = None
            self._rewrite(state, epoch, last)
            vectors, edges, gone = self.tables(epoch + 1)
            start = self.state(epoch + 1)["start"]
            found = graph.greedy_search(queries, vectors, edges, start, self.beam, self.k, gone) if start is not None else queries.sparkSession.createDataFrame([], graph.FOUND)
        found.select("qid", "rk", "id", "dist").write.mode("overwrite").parquet(f"{self.root}/answers/epoch={epoch}")
        self.epoch = epoch + 1
        if n is not None and (n[0] >= max(1, self.threshold * state["n"]) or n[1] > self.share * state["n"]):
            self._repair(epoch + 1)
        self._sweep()
        while self.passing:
            self.passing.pop().destroy()

    def _change(self, state: dict, epoch: int, last: DataFrame) -> tuple[int, int]:
        """Write the batch's changes; returns how many vectors are deleted, and how many came, since the segment."""
        base, over = self._resident(state), self._send(self._overlay(state, epoch))
        ids = last.select("id").toPandas()["id"].to_numpy(np.int64)  # of a batch that fits
        new = last.where("type = 'insert'").select("id", "vec")
        sent, start, beam, r, alpha = self._send(ids), state["start"], self.beam, self.r, self.alpha

        def known(batches):
            view = View(base.value, over.value)
            for rows in batches:
                place, there = view.place(rows["id"].to_numpy(np.int64))
                there[there] = ~view.gone[place[there]]
                yield rows[there]

        def link(batches):
            view = View(base.value, over.value)
            gone = view.gone.copy()
            place, there = view.place(sent.value)
            gone[place[there]] = True
            for rows in batches:
                out = []
                for src, q in zip(rows["id"], rows["vec"]):
                    _, expanded, _ = view.walk(np.asarray(q), start, beam, gone)
                    found = sorted(x for x in expanded if not gone[x[2]])
                    dist = np.array([x[0] for x in found])
                    kept = select(dist, view.vectors(np.array([x[2] for x in found], np.int64)), r, alpha) if found else []
                    out += [(src, i + 1, found[j][1], found[j][0]) for i, j in enumerate(kept)] or [(src, 0, None, None)]
                yield pd.DataFrame(out, columns=["src", "ord", "dst", "dist"]).astype({"dst": "Int64"})

        def lists(batches):
            view = View(base.value, over.value)
            replaced = set(new_ids.value.tolist())
            for rows in batches:
                out = []
                for src in rows["src"].tolist():
                    at = int(view.place(np.array([src]))[0][0])
                    own = view.vectors(np.array([at]))[0]
                    nbrs = np.array([n for n in view[at].tolist() if int(view.every[n]) not in replaced], np.int64)
                    vecs = view.vectors(nbrs)
                    out += [(src, int(view.every[n]), d, x.tolist()) for n, d, x in zip(nbrs, _squares(own[None], vecs) if len(nbrs) else [], vecs)]
                yield pd.DataFrame(out, columns=["src", "dst", "dist", "vec"])

        def measured(batches):
            view = View(base.value, over.value)
            for rows in batches:
                at = view.place(rows["src"].to_numpy(np.int64))[0]
                dist = [float(_squares(view.vectors(np.array([a])), np.asarray(x)[None])[0]) for a, x in zip(at, rows["vec"])]
                yield rows[["src", "dst"]].assign(dist=dist, vec=rows["vec"])[["src", "dst", "dist", "vec"]]

        new_ids = self._send(new.select("id").toPandas()["id"].to_numpy(np.int64))
        out = materialize(new.mapInPandas(link, KEPT))
        schema = "src bigint, dst bigint, dist double, vec array<double>"
        back = out.where("dst IS NOT NULL").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        backs = back.join(new.select(F.col("id").alias("dst"), "vec"), "dst").select("src", "dst", "vec").mapInPandas(measured, schema)
        olds = back.select("src").distinct().mapInPandas(lists, schema)
        redone = backs.unionByName(olds).repartition("src").sortWithinPartitions("src", "dist", "dst").mapInPandas(lambda batches: keep(batches, r, alpha), KEPT)
        now = F.lit(epoch + 1).cast("bigint").alias("epoch")
        deletes = last.where("type = 'delete'").select("id").mapInPandas(known, "id bigint")
        changes = new.select("id", F.lit("insert").alias("kind"), "vec", now).unionByName(deletes.select("id", F.lit("delete").alias("kind"), F.lit(None).cast("array<double>").alias("vec"), now))
        at = f"{self.root}/delta={epoch + 1}"
        changes.write.mode("overwrite").parquet(f"{at}/changes")
        out.unionByName(redone).withColumn("epoch", now).write.mode("overwrite").parquet(f"{at}/lists")
        self._put(epoch + 1, **state)
        every = self._deltas(state, epoch + 1)[0].groupBy("id").agg(F.max_by("kind", "epoch").alias("kind"), F.max("epoch"))
        sums = every.agg(F.count_if(F.expr("kind = 'delete'")).alias("gone"), F.count_if(F.expr("kind = 'insert'")).alias("came")).first()
        return sums["gone"], sums["came"]

    def _ask(self, state: dict, epoch: int, queries: DataFrame) -> DataFrame:
        base, over = self._resident(state), self._send(self._overlay(state, epoch))
        start, beam, k = state["start"], self.beam, self.k

        def search(batches):
            view = View(base.value, over.value)
            for rows in batches:
                out = []
                for qid, q in zip(rows["qid"], rows["qvec"]):
                    work, _, _ = view.walk(np.asarray(q), start, beam, view.gone)
                    out += [(qid, i + 1, x[1], x[0]) for i, x in enumerate([x for x in work if not view.gone[x[2]]][:k])]
                yield pd.DataFrame(out, columns=["qid", "rk", "id", "dist"])

        return queries.mapInPandas(search, "qid bigint, rk int, id bigint, dist double")

    def _rewrite(self, state: dict, epoch: int, last: DataFrame) -> None:
        """The batch's changes as a whole segment, by tables: for an index, or a batch, beyond what is sent to tasks, and for an empty index."""
        vectors, edges, gone = self.tables(epoch)
        new = last.where("type = 'insert'").select("id", "vec")
        deletes = last.where("type = 'delete'").select("id").join(vectors, "id", "left_semi")
        gone = materialize(gone.join(new, "id", "left_anti").union(deletes).distinct())
        if state["start"] is None:
            edges, vectors = None, new
        else:
            edges = graph.insert(vectors, edges, new, state["start"], self.r, self.alpha, self.beam, gone)
            vectors = vectors.join(new, "id", "left_anti").unionByName(new)
            edges, vectors = graph.consolidate(edges, vectors, gone, self.r, self.alpha), vectors.join(gone, "id", "left_anti")
        self._segment(epoch + 1, vectors, edges)

    def _repair(self, epoch: int) -> None:
        vectors, edges, gone = self.tables(epoch)
        vectors, edges = materialize(vectors), materialize(edges)
        self._segment(epoch, vectors.join(gone, "id", "left_anti"), graph.consolidate(edges, vectors, materialize(gone), self.r, self.alpha))

    def _sweep(self) -> None:
        """Remove states before the last but one, and what they alone need."""
        for e in self._states():
            if e < self.epoch - 1:
                delete(self.spark, f"{self.root}/states/state={e}")
        states = [self.state(e) for e in self._states()]
        first, used = min(s["since"] for s in states), {s["segment"] for s in states}
        for n in snapshot._names(self.spark, self.root):
            if n.startswith("segment=") and n not in used or n.startswith("delta=") and int(n[6:]) <= first:
                delete(self.spark, f"{self.root}/{n}")

    def wait(self) -> None:
        """For replay: nothing runs beside the stream."""

    def live(self) -> DataFrame:
        """id, vec of all that can be found."""
        vectors, _, gone = self.tables()
        return vectors.join(gone, "id", "left_anti")

    def answers(self) -> DataFrame:
        """qid (the query's seq), rk, id, dist of all batches."""
        return self.spark.read.parquet(f"{self.root}/answers").drop("epoch")
