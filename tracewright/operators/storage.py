"""Tables between the rounds of an iteration, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A table of `written` may be broadcast up to this many rows.
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


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame) -> DataFrame:
    """The rows as a table of their own: the lineage ends there, and a lost executor costs nothing.  It goes when the program ends, or by `dropped`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/closure-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table of `written` that nothing reads any more."""
    _delete(df.sparkSession, df._written_path)


def to_join(table: DataFrame) -> DataFrame:
    """A table of `written` to join with: by a shuffle, if it has more rows than the driver holds with ease.

    The planner goes by the size of the files, which are compressed: a few MB of
    them can be a GB in the driver's memory.
    """
    return table.hint("merge") if table.count() > BROADCAST_ROWS else table
