"""Written tables between the steps of iterative operators, and epochs of an index."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own where it is unset and all run on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, for as long as the session lasts: its lineage ends there, and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/lodestone-{uuid.uuid4().hex}"
    df.write.parquet(path)
    keep_until_exit(df.sparkSession, path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(table: DataFrame) -> None:
    """Remove a table that materialize has written and that nothing reads any more."""
    spark = table.sparkSession
    _written.remove((spark, table.written_to))
    delete(spark, table.written_to)


_written: list[tuple[SparkSession, str]] = []


def keep_until_exit(spark: SparkSession, path: str) -> None:
    """Remove the folder path when the session's process ends."""
    _written.append((spark, path))


@atexit.register
def _sweep() -> None:
    for spark, path in _written:
        try:
            delete(spark, path)
        except Exception:  # the session has ended already
            return


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder, wherever it is stored."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def numbered(df: DataFrame, *order: str, column: str = "seq") -> DataFrame:
    """df with its rows numbered from 1 in the order of columns that no two rows share, in as many tasks as there are ranges."""
    ranges = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("_n"))  # one row for each range
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranges.withColumn("_within", within).join(F.broadcast(before), "_range").withColumn(column, (F.col("_before") + F.col("_within")).cast("bigint")).drop("_range", "_within", "_before")


class EpochTaken(RuntimeError):
    """Another writer has committed the epoch first."""


def _names(spark: SparkSession, path: str) -> list[str]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []


def _claim(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file that is not there; False where it is. On file systems with an atomic create (HDFS, local) one of several writers gets it."""
    raw = text.encode()
    if path.startswith("/") or path.startswith("file:"):
        local = Path("/" + path.removeprefix("file:").lstrip("/"))
        local.parent.mkdir(parents=True, exist_ok=True)
        draft = local.with_name(f"_{uuid.uuid4().hex}")
        draft.write_bytes(raw)
        try:
            os.link(draft, local)  # whole, or not at all
            return True
        except FileExistsError:
            return False
        finally:
            draft.unlink()
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    out.write(bytearray(raw))
    out.close()
    return True


def _text(spark: SparkSession, path: str) -> str:
    return "".join(r["value"] for r in spark.read.text(path).collect())  # one line


def write_epoch(root: str, epoch: int, **tables: DataFrame) -> None:
    """Write the tables of an epoch to a folder of their own, then the marker by which readers find it; EpochTaken where another writer has set that marker."""
    spark = next(iter(tables.values())).sparkSession
    folder = f"epoch={epoch}-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{root}/{folder}/{name}")
    if not _claim(spark, f"{root}/_epochs/{epoch}", folder):
        delete(spark, f"{root}/{folder}")
        raise EpochTaken(f"epoch {epoch} of {root} is there")


def read_epoch(spark: SparkSession, root: str, epoch: int | None = None) -> tuple[int, dict[str, DataFrame]]:
    """The given or the last whole epoch and its tables."""
    epoch = max(int(n) for n in _names(spark, f"{root}/_epochs") if n.isdigit()) if epoch is None else epoch
    folder = f"{root}/{_text(spark, f'{root}/_epochs/{epoch}')}"
    return epoch, {n: spark.read.parquet(f"{folder}/{n}") for n in _names(spark, folder)}
