"""Best-fit packing of documents into token sequences after a dominance reduction.

The corpus is reduced to how many pieces there are of each length, at most
`CAPACITY` numbers, which the driver packs for the whole corpus at once.  The
plan says, for each length, which sequences take its pieces from which rank on;
pieces are ranked by length without any large group in one task, and look their
place up in the plan.

A document is its ids and an end id; a null text is the end id alone.  Longer
documents are cut into full pieces and a last one.  Repeated rows are packed as
often as they stand there, and are spread over tasks like others, as are all rows
of one doc_id.  Ties: pieces of one length are alike to the plan; which of them
goes where depends on their ids and on the order in which they were written.  An
empty table gives an empty one.  Columns beyond the id and the text aren't read,
whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, read, small_batches
from .encoding import Encoder, compiled
from .op4_bpe import WORD_BPE
from .packing import Pattern, pack

CAPACITY, END = 2048, 0
#: About so many pieces of one length are ranked together.
RANKED = 50_000


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", path: str = WORD_BPE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the pieces of every document."""
    lexicon = compiled(docs, text_col, path)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(lexicon.value)
        end = np.array([END], "<u4").tobytes()
        for pdf in batches:
            ids, counts = encoder.encode(pdf["text"].tolist())
            flat, at, rows = ids.astype("<u4").tobytes(), 0, []
            for key, n in zip(pdf["doc_id"].tolist(), counts.tolist(), strict=True):
                own = flat[4 * at : 4 * (at + n)] + end
                at += n
                rows += [(key, i, s, len(x) // 4, zlib.crc32(x)) for i, s in enumerate(range(0, n + 1, capacity)) if (x := own[4 * s : 4 * (s + capacity)])]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"`{id_col}` as doc_id", f"`{text_col}` as text").mapInPandas(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def slots(plan: list[Pattern]) -> list[tuple]:
    """(length, first rank, pieces, pieces a sequence, first sequence, offset) of each run of like places."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for items, n in plan:
        offset = 0
        for size, each in items:
            first = rank.get(size, 0)
            rows.append((size, first, n * each, each, sequence, offset))
            rank[size] = first + n * each
            offset += size * each
        sequence += n
    return rows


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` with sequence_id and offset; a column length says how long each is."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    groups = 1 + sum(counts.values()) // RANKED
    plan = spark.createDataFrame(slots(pack(counts, capacity)), "length long, first long, taken long, each long, sequence long, at long")
    # `_row`, where the pieces have it, tells even equal rows apart
    keyed = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", *(["_row"] if "_row" in pieces.columns else [])), F.lit(groups)))
    before = keyed.groupBy("length", "_group").agg(F.count("*").alias("n")).withColumn("_before", F.sum("n").over(W.partitionBy("length").orderBy("_group").rowsBetween(W.unboundedPreceding, -1))).drop("n")
    own = F.row_number().over(W.partitionBy("length", "_group").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = keyed.withColumn("_own", own).join(before, ["length", "_group"]).withColumn("_rank", F.col("_own") + F.coalesce("_before", F.lit(0)))
    # the plan has a few rows for each of at most `capacity` lengths, however large the corpus
    placed = ranked.join(F.broadcast(plan), "length").where("_rank >= first and _rank < first + taken").withColumn("_place", F.col("_rank") - F.col("first"))
    return placed.select(*pieces.columns, (F.col("sequence") + F.floor(F.col("_place") / F.col("each"))).cast("long").alias("sequence_id"), (F.col("at") + F.col("_place") % F.col("each") * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", path: str = WORD_BPE) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    scratch = Scratch(docs.sparkSession, "pieces")
    pieces = scratch.table(pieces_of(docs, capacity, id_col, text_col, path).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    return place(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
