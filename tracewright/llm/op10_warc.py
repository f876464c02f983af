"""WARC archives of pages, and reading them back through the data source.

Of the records with one payload, that of the largest page_id is a response, and
the others revisit it.  Rows that repeat that page_id are responses too; a null
page_id revisits like a smaller one, and where a payload has no other id its
records are responses.  A null html is an empty payload.

An empty table gives no archive and an empty result; columns beyond id, url and
payload aren't read, whatever their names.  A payload is held whole by the task that
writes or verifies it, one at a time.

A task writes its own files; only what finished tasks report gets into the
manifest, so a lost executor's files are never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read, small_batches
from .warc import ArchiveWriter, WarcSource, record

NAME = "urn:page:"


def with_originals(pages: DataFrame, scratch: Scratch, id_col: str = "page_id", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """`pages` with __original: the page whose payload it repeats, or null."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    key = F.when(F.octet_length(payload) >= least_bytes, F.sha2(payload, 256))
    shared = pages.select(key.alias("__key"), F.col(id_col).alias("__id")).where("__key is not null").groupBy("__key").agg(F.max("__id").alias("__first"), F.count("*").alias("__n"))
    # written first, so that the planner knows its size: pages move only if it is too large to broadcast
    shared = scratch.table(shared.where("__n > 1").drop("__n"), "shared")
    joined = pages.withColumn("__key", key).join(shared, "__key", "left")
    return joined.withColumn("__original", F.when(~F.col(id_col).eqNullSafe(F.col("__first")), F.col("__first"))).drop("__key", "__first")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write a record per row to files in `folder`; (path, bytes, records) of the files. `__original` marks revisits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer = ArchiveWriter(folder, f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}")
        for pdf in batches:
            for key, uri, payload, original in zip(pdf["id"], pdf["url"], pdf["payload"], pdf["original"], strict=True):
                writer.add(record(NAME + (key or ""), uri, (payload or "").encode("utf-8", "surrogatepass"), original and NAME + original))
        writer.close()
        yield pd.DataFrame(writer.files, columns=["path", "bytes", "records"]).astype({"path": object, "bytes": "int64", "records": "int64"})

    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.col(url_col).alias("url"), F.col(payload_col).alias("payload"), F.col("__original").cast("string").alias("original"))
    return rows.mapInPandas(run, "path string, bytes long, records long")


def read_archives(spark: SparkSession, **options: str) -> DataFrame:
    """The records of archives; see `WarcReader` for the options."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").options(**options).load()


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    pages = read(spark, sf_dir, "pages")
    files = scratch.table(write_archives(with_originals(pages, scratch), scratch.path("archives")), "manifest")
    back = read_archives(spark, manifest=files._scratch_path, payload="false").where(F.col("record_type").isin("response", "revisit"))
    number = lambda c: F.expr(f"try_cast(substring({c}, {len(NAME) + 1}) as bigint)")
    return back.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


#: Twenty bits of the hexadecimal digest are four letters of base32.
_LETTERS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((v >> {s}) & 31 as integer) + 1, 1)" for s in (15, 10, 5, 0))
ORACLE_SQL = f"""
with p as (select page_id, coalesce(html, '') as html from pages), f as (select html, max(page_id) as first from p group by html),
j as (select p.page_id, f.first, strlen(p.html) as payload_bytes, sha1(p.html) as h from p join f on p.html = f.html)
select page_id, cast(payload_bytes as bigint) as payload_bytes, list_reduce(list_transform(list_transform(range(0, 8), lambda i: cast('0x' || substr(h, cast(5 * i + 1 as integer), 5) as bigint)), lambda v: {_LETTERS}), lambda a, b: a || b) as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to from j"""
