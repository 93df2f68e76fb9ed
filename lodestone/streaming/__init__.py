"""Replay of event streams: micro-batches of inserts, deletes and queries against an index of segments."""

from __future__ import annotations

import threading
import uuid

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestone.operators import events as ev
from lodestone.operators.knn import dimension, knn
from lodestone.operators.snapshot import _claim, _names, _text, delete, discard, keep_until_exit, materialize, numbered, shared_dir
from lodestone.sources import read_events

EVENTS = "seq bigint, type string, t bigint, id bigint, vec array<double>"


class Index:
    """Static vectors, fresh ones and tombstones, as tables under root; every batch writes the next state.

    A state is the fresh vectors, the tombstones, each with the batch that they
    came with, and the number of the static segment that they belong to; static
    vectors are written anew only when segments are merged. Within a batch
    deletes and inserts are applied in the order of the log, so that an id's
    last change decides; inserts without a vector are no events; queries see the state after the batch. When deletes
    reach threshold of all vectors, or fresh vectors fresh_share of the static
    ones, segments are merged and tombstones cleared: within the batch, or, with
    background, beside the following ones, of which the first to begin after the
    merge takes it over; what came after the merge began stays fresh or deleted.
    Without static an index that is there under root goes on from its last whole
    state. States and segments that no delivered batch can ask for are removed.
    """

    def __init__(self, spark: SparkSession, root: str, static: DataFrame | None = None, threshold: float = 0.05, fresh_share: float = 0.08, k: int = 10, background: bool = False):
        self.spark, self.root, self.threshold, self.fresh_share, self.k, self.background = spark, root, threshold, fresh_share, k, background
        self.merging: threading.Thread | None = None
        self.merged: tuple[int, int] | None = None  # a segment that waits, and the last batch in it
        self.failed: BaseException | None = None
        self.answering: threading.Thread | None = None
        self.beside = False  # whether a batch's queries are answered while the next is applied; answered() waits
        self.of: dict[int, int] = {}  # segments of the states that were written or read here
        self.sizes: dict[int, tuple[int, int | None]] = {}  # vectors and their dimension, by segment
        if static is None:
            found = self._states()
            if not found:
                raise ValueError(f"no index under {root}")
            self.epoch = max(found)
            return
        delete(spark, root)
        self.epoch = 0
        static.select("id", "vec").write.mode("overwrite").parquet(f"{root}/static=0")
        none = static.select("id", "vec", F.lit(0).cast("bigint").alias("batch")).limit(0)
        self._write(0, none, none.select("id", "batch"))

    def _list(self, folder: str = "") -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []

    def _states(self) -> list[int]:
        """Numbers of the states that are whole: their marker is written last."""
        return [int(n[6:]) for n in self._list() if n.startswith("epoch=") and "_SUCCESS" in self._list(f"{n}/of")]

    def _write(self, segment: int, fresh: DataFrame, tombstones: DataFrame) -> tuple[int, int]:
        """Write the state of the epoch; how many are fresh and deleted."""
        at = f"{self.root}/epoch={self.epoch}"
        delete(self.spark, f"{at}/of")
        seen = Observation(), Observation()  # rows are counted as they are written
        fresh.observe(seen[0], F.count("*").alias("n")).write.mode("overwrite").parquet(f"{at}/fresh")
        tombstones.observe(seen[1], F.count("*").alias("n")).write.mode("overwrite").parquet(f"{at}/tombstones")
        self.spark.range(1, numPartitions=1).select(F.lit(segment).cast("bigint").alias("segment")).write.mode("overwrite").parquet(f"{at}/of")
        self.of[self.epoch] = segment
        return tuple(x.get["n"] for x in seen)

    def segment(self, epoch: int | None = None) -> int:
        epoch = self.epoch if epoch is None else epoch
        if epoch not in self.of:
            self.of[epoch] = self.spark.read.schema("segment bigint").parquet(f"{self.root}/epoch={epoch}/of").first()["segment"]
        return self.of[epoch]

    def size(self, segment: int) -> tuple[int, int | None]:
        """Vectors of a segment, which does not change, and their dimension."""
        if segment not in self.sizes:
            static = self.spark.read.parquet(f"{self.root}/static={segment}")
            self.sizes[segment] = static.count(), dimension(static)
        return self.sizes[segment]

    def table(self, name: str) -> DataFrame:
        if name == "static":
            return self.spark.read.parquet(f"{self.root}/static={self.segment()}")
        kind = f"id bigint, {'vec array<double>, ' if name == 'fresh' else ''}batch bigint"
        return self.spark.read.schema(kind).parquet(f"{self.root}/epoch={self.epoch}/{name}")

    def live(self) -> DataFrame:
        """id, vec, segment of all that can be found; a fresh vector stands before a static one of its id."""
        static, fresh = self.table("static"), self.table("fresh").select("id", "vec")
        both = static.join(fresh, "id", "left_anti").withColumn("segment", F.lit("static")).unionByName(fresh.withColumn("segment", F.lit("fresh")))
        return both.join(self.table("tombstones"), "id", "left_anti")

    def merge(self, upto: int) -> None:
        """Write what is live as the static segment of the batch upto, the last that the state holds."""
        number = upto + 1
        self.live().select("id", "vec").write.mode("overwrite").parquet(f"{self.root}/static={number}")
        self.merged = number, upto

    def _merge_beside(self, upto: int) -> None:
        then = Index.__new__(Index)
        then.__dict__ = self.__dict__ | {"merged": None}

        def run() -> None:
            try:
                then.merge(upto)
                self.merged = then.merged
            except BaseException as e:
                self.failed = e

        self.merging = threading.Thread(target=run, daemon=True)
        self.merging.start()

    def wait(self) -> None:
        """Until a merge that goes on has ended."""
        if self.merging is not None:
            self.merging.join()
            self.merging = None
        if self.failed is not None:
            raise self.failed

    def apply(self, batch: DataFrame, epoch: int) -> None:
        """One micro-batch of (seq, t, type, id, vec). It reads the state numbered epoch and writes the next, so a batch that comes twice leaves the same state."""
        self.epoch = epoch
        if self.merging is not None and not self.merging.is_alive():
            self.wait()
        segment, fresh, tombstones = self.segment(), self.table("fresh"), self.table("tombstones")
        if self.merged and self.merged[0] > segment and self.merged[1] < epoch:
            segment, upto = self.merged
            fresh, tombstones = (t.where(F.col("batch") > upto) for t in (fresh, tombstones))
        static = self.spark.read.parquet(f"{self.root}/static={segment}")
        last = materialize(ev.valid(batch).where("type IN ('insert', 'delete')").groupBy("id").agg(F.max_by(F.struct("type", "vec"), F.struct("t", "seq")).alias("x")).select("id", "x.type", "x.vec"))
        now = F.lit(epoch).cast("bigint").alias("batch")
        inserts = last.where("type = 'insert'").select("id", "vec", now)
        known = static.select("id").unionByName(fresh.select("id"))
        deletes = last.where("type = 'delete'").select("id", now).join(known, "id", "left_semi").join(tombstones, "id", "left_anti")
        tombstones = tombstones.join(inserts, "id", "left_anti").unionByName(deletes)
        fresh = fresh.join(last, "id", "left_anti").unionByName(inserts)
        self.epoch = epoch + 1
        n_fresh, n_gone = self._write(segment, fresh, tombstones)
        self._sweep()
        n_static, dim = self.size(segment)
        due = n_gone and n_gone >= int((n_static + n_fresh) * self.threshold) or n_fresh and n_fresh >= n_static * self.fresh_share
        if due and self.background and self.merging is None:
            self._merge_beside(epoch)
        elif due and not self.background:
            self.merge(epoch)
            self._write(epoch + 1, fresh.limit(0), tombstones.limit(0))
        discard(last)
        queries = batch.where("type = 'query' AND vec IS NOT NULL").select(F.col("seq").alias("qid"), F.col("vec").alias("qvec"))
        live, root, n = self.live().select("id", "vec"), self.root, n_static + n_fresh

        def answer() -> None:
            try:
                knn(queries, live, self.k, dim=dim, n_pairs=queries.count() * n).write.mode("overwrite").parquet(f"{root}/answers/epoch={epoch}")
            except BaseException as e:
                self.failed = e

        self.answered()  # states are kept until the batch after the next
        self.answering = threading.Thread(target=answer, daemon=True)
        self.answering.start()
        if not self.beside:
            self.answered()

    def answered(self) -> None:
        """Until the queries of the last batch are answered."""
        if self.answering is not None:
            self.answering.join()
            self.answering = None
        if self.failed is not None:
            raise self.failed

    def _sweep(self) -> None:
        """Remove states before the last but one, and segments that neither has nor a merge makes."""
        kept = {self.epoch, self.epoch - 1}
        for e in self._states():
            if e < self.epoch - 1:
                delete(self.spark, f"{self.root}/epoch={e}")
                self.of.pop(e, None)
        used = {self.segment(e) for e in kept if e in self._states()}
        for n in self._list():
            if n.startswith("static=") and int(n[7:]) < min(used):
                delete(self.spark, f"{self.root}/{n}")

    def answers(self) -> DataFrame:
        """qid (the query's seq), rk, id, dist of all batches."""
        return self.spark.read.parquet(f"{self.root}/answers").drop("epoch")


class EventBatches:
    """Hands what a trigger has taken to an index in batches of at most so many events, in order of (t, seq).

    Where the batches of a trigger begin is written under the index, so that one
    that comes twice is cut as before.
    """

    def __init__(self, index, events: int):
        self.index, self.events = index, events

    def apply(self, taken: DataFrame, epoch: int) -> None:
        spark, root = self.index.spark, f"{self.index.root}/batches"
        names = _names(spark, root)
        first = int(_text(spark, f"{root}/{epoch}")) if str(epoch) in names else self.index.epoch
        if str(epoch) not in names:
            _claim(spark, f"{root}/{epoch}", str(first))
        path = f"{shared_dir(spark)}/lodestone-{uuid.uuid4().hex}"
        keep_until_exit(spark, path)
        rows = numbered(taken, "t", "seq", column="_place").withColumn("_batch", F.floor((F.col("_place") - 1) / self.events)).drop("_place")
        rows.write.partitionBy("_batch").parquet(path)
        self.index.beside = True
        try:
            for i in range(sum(n.startswith("_batch=") for n in _names(spark, path))):  # every batch reads its own files
                self.index.apply(spark.read.schema(taken.schema).parquet(f"{path}/_batch={i}"), first + i)
        finally:
            self.index.beside = False
            getattr(self.index, "answered", lambda: None)()
        delete(spark, path)


STATE = "id bigint, live boolean, t bigint, seq bigint, inserts bigint, deletes bigint"


class LiveState(StatefulProcessor):
    """By id: whether its last change by (t, seq) is an insert, and how many inserts and deletes there were."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("live", "live boolean, t bigint, seq bigint, inserts bigint, deletes bigint")

    def handleInputRows(self, key, rows, timerValues):
        live, t, seq, inserts, deletes = self.state.get() if self.state.exists() else (False, None, None, 0, 0)
        for part in rows:
            for kind, at, number in zip(part["type"], part["t"], part["seq"]):
                inserts, deletes = inserts + (kind == "insert"), deletes + (kind == "delete")
                if t is None or (at, number) > (t, seq):
                    live, t, seq = kind == "insert", int(at), int(number)
        self.state.update((live, t, seq, inserts, deletes))
        yield pd.DataFrame([(key[0], live, t, seq, inserts, deletes)], columns=["id", "live", "t", "seq", "inserts", "deletes"])

    def close(self) -> None:
        pass


def live_state(spark: SparkSession, path: str, checkpoint: str, out: str, files_per_batch: int = 1) -> DataFrame:
    """STATE of every id after the event files under path that are there; goes on where it ended when called again.

    State is kept by id in the stream's state store; each batch writes the ids
    that it has changed to a folder of its number, so that one that comes twice
    leaves the same.
    """
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).json(path)
        changes = raw.where("type IN ('insert', 'delete') AND id IS NOT NULL").groupBy("id").transformWithStateInPandas(LiveState(), STATE, "Update", "None")
        write = lambda df, epoch: df.write.mode("overwrite").parquet(f"{out}/batch={epoch}")
        changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before)
    rows = spark.read.schema(f"{STATE}, batch bigint").parquet(out)
    return rows.groupBy("id").agg(F.max_by(F.struct("live", "t", "seq", "inserts", "deletes"), "batch").alias("x")).select("id", "x.*")


def replay(spark: SparkSession, path: str, index: Index, checkpoint: str, files_per_batch: int | None = 1, every: str | None = None, seconds: int | None = None, events: int | None = None) -> None:
    """Run event files under path through the index, the oldest first (Spark takes files by their time).

    All that are there, or, with every ('5 seconds'), a batch each time of what
    has come, for so many seconds, and then what is left. files_per_batch None
    reads logs in either dialect. With events, the index gets what a
    trigger has taken in batches of at most so many events, in order of (t, seq)
    whatever files they are in.
    """
    apply = index.apply if events is None else EventBatches(index, events).apply
    if files_per_batch is None:
        raw = ev.normalize_dialects(read_events(spark, path, stream=True).withColumn("seq", F.coalesce("t", F.col("timestamp").cast("bigint"))))
    else:
        raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).json(path)
    stream = raw.where(F.col("type").isin(*ev.TYPES)).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    if every is None:
        stream.trigger(availableNow=True).start().awaitTermination()
    else:
        query = stream.trigger(processingTime=every).start()
        try:
            query.awaitTermination(seconds)
            query.processAllAvailable()
        finally:
            query.stop()
    index.wait()


def counts(spark: SparkSession, path: str, checkpoint: str, out: str, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Events by type in windows of event time, as appended to the table out: windows that have closed.

    A window closes when an event is delay later than its end; events of closed
    windows count no more, and their state is dropped.
    """
    raw = spark.readStream.schema(EVENTS).json(path)
    timed = raw.where(F.col("type").isin(*ev.TYPES)).withColumn("at", F.timestamp_micros("t")).withWatermark("at", delay)
    agg = timed.groupBy(F.window("at", width), "type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "type", "n")
    agg.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("start timestamp, type string, n bigint").parquet(out)
