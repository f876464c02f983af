"""Token ids in binary files: static range asymmetric numeral system, blocks for parallel decoding.

1. Documents are put in order of doc_id (nulls first) by range partitions, encoded,
   and cut into blocks of whole documents with about `BLOCK` ids.
2. The counts of all ids of the corpus make the shared frequency table.
3. Each block is coded by itself and appended to a file of its range; the manifest
   has a row per block, and a sum over the ranges says where each begins.
4. Reading goes by the manifest: any task can decode any block.

A null or empty text is the end id alone.  Rows that repeat a doc_id each have their
own place, in the order in which they were read, and may fill several ranges; so may
null ids, which come first.  A task streams its range block by block, so a range's
size is no matter of memory.  Only files of finished tasks are in the manifest.
Ties in doc_id keep the order of reading.  An empty table gives no file and an empty
result.  Columns beyond id and text aren't read, whatever their names.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, read, small_batches
from .encoding import Encoder, compiled
from .rans import Block, Table, encode_block
from .warc import _uri

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
END, BLOCK, RANGE_ROWS, FILE_BYTES = 0, 1 << 19, 8000, 128 << 20
_BLOCKS = "range int, block int, keys binary, valid binary, counts binary, ids binary, symbols array<int>, seen array<long>"


def blocks_of(docs: DataFrame, id_col: str, text_col: str, path: str, end: int = END) -> DataFrame:
    """Rows of `_BLOCKS`: the blocks in order within each range, and per task a row of its counts of ids."""
    lexicon = compiled(docs, text_col, path)
    small_batches(docs.sparkSession)
    ranges = 1 + docs.count() // RANGE_ROWS
    # the place among all rows splits an id that very many rows have, or the null ids
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("place"))
    rows = rows.repartitionByRange(ranges, "key", "place").sortWithinPartitions("key", "place").drop("place")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(lexicon.value)
        size = max(encoder.splitter.merges.vocab.values()) + 1
        seen = np.zeros(size, np.int64)
        kind = np.uint16 if size <= 1 << 16 else np.uint32
        held: list[tuple] = []
        count = number = 0

        def block() -> pd.DataFrame:
            nonlocal held, count, number
            keys, valid, counts, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            row = {"range": 0, "block": number, "keys": keys.astype("<i8").tobytes(), "valid": valid.astype("u1").tobytes(), "counts": counts.astype("<i8").tobytes(), "ids": ids.astype("<u4" if kind is np.uint32 else "<u2").tobytes(), "symbols": [], "seen": []}
            held, count, number = [], 0, number + 1
            return pd.DataFrame([row])

        for pdf in batches:
            for at in range(0, len(pdf), 100):
                part = pdf.iloc[at : at + 100]
                ids, counts = encoder.encode(part["text"].tolist())
                ids = np.insert(ids, np.cumsum(counts), end)
                seen += np.bincount(ids, minlength=size)
                valid = part["key"].notna().to_numpy()
                held.append((part["key"].where(valid, 0).to_numpy(np.int64, na_value=0), valid, counts + 1, ids.astype(kind)))
                count += len(ids)
                if count >= BLOCK:
                    yield block()
        if held:
            yield block()
        symbols = np.flatnonzero(seen)
        yield pd.DataFrame([{"range": -1, "block": 0, "keys": b"", "valid": b"", "counts": b"", "ids": b"", "symbols": symbols.tolist(), "seen": seen[symbols].tolist()}])

    out = rows.mapInPandas(run, _BLOCKS)
    return out.withColumn("range", F.when(F.col("range") < 0, -1).otherwise(F.spark_partition_id()))


def write_blocks(blocks: DataFrame, table: Table, folder: str) -> DataFrame:
    """Code the blocks into files of `folder`; a row per block: path, at, bytes, range, block, n_ids."""
    shared = blocks.sparkSession.sparkContext.broadcast(table.to_bytes())
    store, where = fs.FileSystem.from_uri(_uri(folder))
    store.create_dir(where, recursive=True)
    with store.open_output_stream(f"{where}/table.bin", compression=None) as f:
        f.write(table.to_bytes())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Table.from_bytes(shared.value)
        store, where = fs.FileSystem.from_uri(_uri(folder))
        out, name, current, at = None, "", None, 0
        rows = []
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if out is None or r.range != current or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, current, at = f"{r.range:08d}-{r.block:08d}-{uuid.uuid4().hex[:12]}.rans", r.range, 0
                    out = store.open_output_stream(f"{where}/{name}", compression=None)
                counts = np.frombuffer(r.counts, "<i8")
                n = int(counts.sum())
                ids = np.frombuffer(r.ids, "<u2" if 2 * n == len(r.ids) else "<u4")
                data = encode_block(np.frombuffer(r.keys, "<i8"), np.frombuffer(r.valid, "u1"), counts, ids, own)
                out.write(data)
                rows.append((name, at, len(data), r.range, r.block, n))
                at += len(data)
        if out is not None:
            out.close()
        yield pd.DataFrame(rows, columns=["path", "at", "bytes", "range", "block", "n_ids"])

    return blocks.where("range >= 0").select("range", "block", "keys", "valid", "counts", "ids").mapInPandas(run, "path string, at long, bytes long, range int, block int, n_ids long")


def read_blocks(manifest: DataFrame, folder: str, read_ids: bool = False) -> DataFrame:
    """A row per document: doc_id, start, n_tokens, ids_crc32, and with `read_ids` the ids."""
    totals = manifest.groupBy("range").agg(F.sum("n_ids").alias("n"))
    base = totals.select("range", F.coalesce(F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inner = F.coalesce(F.sum("n_ids").over(W.partitionBy("range").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.withColumn("inner", inner).join(base, "range").withColumn("first", F.col("inner") + F.col("base"))
    tasks = max(1, manifest.count() // 8)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, where = fs.FileSystem.from_uri(_uri(folder))
        with store.open_input_file(f"{where}/table.bin") as f:
            table = Table.from_bytes(f.read())
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                with store.open_input_file(f"{where}/{r.path}") as f:
                    f.seek(r.at)
                    block = Block(f.read(r.bytes), table)
                flat, ends = block.ids().astype("<u4").tobytes(), np.cumsum(block.counts)
                each = [flat[4 * (e - c) : 4 * e] for e, c in zip(ends.tolist(), block.counts.tolist(), strict=True)]
                out = pd.DataFrame({"doc_id": pd.array(block.keys, dtype="Int64"), "start": r.first + ends - block.counts, "n_tokens": block.counts, "ids_crc32": [zlib.crc32(x) for x in each]})
                out.loc[~block.valid, "doc_id"] = pd.NA
                if read_ids:
                    out["ids"] = each
                yield out

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * read_ids
    return placed.select("path", "at", "bytes", "first").repartition(tasks, "path", "at").mapInPandas(run, schema)


def write_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = BYTE_BPE) -> tuple[DataFrame, str]:
    """(the manifest, the folder) of the corpus's ids in files."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    blocks = scratch.table(blocks_of(docs, id_col, text_col, path), "blocks")
    counted = blocks.where("range < 0").select(F.explode(F.arrays_zip("symbols", "seen")).alias("x")).groupBy("x.symbols").agg(F.sum("x.seen").alias("n"))
    table = Table.of_counts({r[0]: r[1] for r in counted.collect()})  # at most one row per id of the vocabulary
    folder = scratch.path("files")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")  # a block is a megabyte
    try:
        manifest = scratch.table(write_blocks(blocks, table, folder), "manifest")
    finally:
        small_batches(spark)
    scratch.drop(blocks)
    return manifest, folder


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_blocks(*write_tokens(read(spark, sf_dir, "documents")))
