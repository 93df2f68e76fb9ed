"""Session settings and shared tables for operators that hand batches to Python."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: dict[str, SparkSession] = {}


def tune(spark: SparkSession, rows: int = 1000, mb: int = 16) -> None:
    """Bound the Arrow batches handed to Python by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all run on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here and losing an executor costs nothing.

    The table lasts as long as the session, since results that read it are lazy.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written[path] = spark
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def keep_until_exit(spark: SparkSession, path: str) -> None:
    """Remove the folder path when the session's process ends."""
    _written[path] = spark


def discard(table: DataFrame) -> None:
    """Remove a table that materialize has written and that no result reads any more."""
    spark = _written.pop(table.written_to)
    at = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _sweep() -> None:
    for path, spark in _written.items():
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended already
            return


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of df, which for files is their length; where it has none, 4 KB a row."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else df.count() << 12


def fresh_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df is called so, in capitals or not."""
    there = {c.lower() for c in df.columns}
    while name.lower() in there:
        name = f"_{name}"
    return name


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids give -1."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n)), F.lit(-1)).cast("int")
