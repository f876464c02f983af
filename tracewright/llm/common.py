"""What the operators of this subpackage share: scratch tables and small columns."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch: bounds a Python worker's memory by rows and by bytes.
BATCH_ROWS = 1000
#: A table of a few short columns is broadcast up to this many rows, about 30 MB in memory.
BROADCAST_ROWS = 400_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; where it is unset in local mode (tests), an own one is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tracewright-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's own file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables written to the shared folder to cut lineage.

    A table survives the loss of executors, because every executor can read it
    again.  `drop` removes one that nothing reads any more; what is left, since
    results read it, goes when the driver's program ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._forget)

    def _forget(self) -> None:
        with contextlib.suppress(Exception):  # the session may have ended before
            drop_path(self.spark, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def table(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = self.path(name)
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            drop_path(self.spark, t._scratch_path)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers of this session get."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def crc_bucket(col: str, n: int) -> Column:
    """crc32 of the value as text, modulo n (null for null)."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(n))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def smaller_side(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The table to join with, broadcast if it is counted not to exceed the bound; else a shuffled join, which adaptive execution can split."""
    return F.broadcast(table) if table.count() <= rows else table
