"""Approximate nearest neighbours: a navigable small-world graph per shard, results merged.

1. Equal vectors are one representative with its least ids, so a vector that a
   third of all rows share is one node, and its copies are still found, exactly.
2. Representatives are dealt to shards by a hash; each shard's graph is one row of
   flat arrays.  A shard has about `SHARD_ROWS` nodes whatever the table's size.
3. Queries are gathered in blocks, each block meets each shard once, and keeps
   the best of what the graph finds, by cosines in double precision.
4. The shards' results are merged for each query.

Vectors that are null, zero, or hold a null or a number that isn't finite take no
part, nor do null ids; vectors of different lengths don't meet.  Rows are
candidates: an id that has several vectors may answer by each of them, so it can
take several ranks; rows that repeat id and vector are one.  Of an id's vectors the
least one asks, and none of them is an answer to it.  Ties go to the smaller id.  An
empty table, or one without a vector that takes part, gives an empty one.  Columns
beyond id and vector aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, read, small_batches
from .hnsw import Graph

SHARD_ROWS, BLOCK_ROWS, EF = 8192, 2048, 192


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0")
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~odd).where(F.exists("v", lambda x: x != 0))


def representatives(rows: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """(ids, v, width): each different vector with its k + 1 least ids."""
    keyed = rows.select("id", "v", F.xxhash64("v").alias("h0"), F.xxhash64(F.lit(1), "v").alias("h1"))
    place = F.row_number().over(W.partitionBy("h0", "h1").orderBy("id"))
    # ids are made distinct first: rows that repeat one id must not take the places of others
    few = keyed.dropDuplicates(["h0", "h1", "id"]).withColumn("place", place).where(F.col("place") <= k + 1)
    reps = few.groupBy("h0", "h1").agg(F.slice(F.array_sort(F.array_distinct(F.collect_list("id"))), 1, k + 1).alias("ids"), F.first("v").alias("v"))
    return scratch.table(reps.select("ids", "v", F.size("v").alias("width")), "vectors")


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.iloc[np.argsort([x[0] for x in pdf["ids"]], kind="stable")]
    x = np.stack(pdf["v"].to_numpy())
    unit = x / np.linalg.norm(x / np.abs(x).max(1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(1, keepdims=True)
    sizes = np.fromiter(map(len, pdf["ids"]), np.int64, len(pdf))
    return pd.DataFrame([{"width": x.shape[1], "shard": pdf["shard"].iloc[0], "graph": Graph.build(unit).to_bytes(), "sizes": sizes.tobytes(), "ids": np.concatenate(list(pdf["ids"])).astype(np.int64).tobytes(), "vectors": x.tobytes()}])


def _gather(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame([{"width": pdf["width"].iloc[0], "block": pdf["block"].iloc[0], "queries": pdf["id"].to_numpy(np.int64).tobytes(), "asked": np.stack(pdf["v"].to_numpy()).tobytes()}])


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows in double precision, without overflow."""
    a, b = a / np.abs(a).max(-1, keepdims=True), b / np.abs(b).max(-1, keepdims=True)
    return (a * b).sum(-1) / (np.sqrt((a * a).sum(-1)) * np.sqrt((b * b).sum(-1)))


def _searcher(k: int, ef: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                graph, x = Graph.from_bytes(r.graph), np.frombuffer(r.vectors).reshape(-1, r.width)
                sizes, ids = np.frombuffer(r.sizes, np.int64), np.frombuffer(r.ids, np.int64)
                first = np.cumsum(sizes) - sizes
                queries, asked = np.frombuffer(r.queries, np.int64), np.frombuffer(r.asked).reshape(-1, r.width)
                unit = asked / np.abs(asked).max(1, keepdims=True)
                unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
                nodes, _ = graph.search(unit, 3 * (k + 1), ef)
                q, c = np.nonzero(nodes >= 0)
                node = nodes[q, c]
                score = cosines(asked[q], x[node])
                # every representative stands for its ids
                n = sizes[node]
                each = np.repeat(np.arange(len(node)), n)
                vec = ids[np.repeat(first[node] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
                q, score = q[each], score[each]
                other = vec != queries[q]
                q, score, vec = q[other], score[other], vec[other]
                order = np.lexsort((vec, -score, q))
                q, score, vec = q[order], score[order], vec[order]
                rank = np.arange(len(q)) - np.searchsorted(q, q)
                keep = rank < k
                yield pd.DataFrame({"query_id": queries[q[keep]], "vec_id": vec[keep], "score": score[keep]})

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, ef: int = EF) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of `vectors` found for each row of `queries`."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "nearest")
    reps = representatives(usable(vectors, id_col, vector_col), k, scratch)
    sizes = {r["width"]: r["n"] for r in reps.groupBy("width").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shards = F.create_map(*[F.lit(int(x)) for w, n in sizes.items() for x in (w, -(-n // shard_rows))])[F.col("width")]
    dealt = reps.withColumn("shard", F.pmod(F.xxhash64(F.lit(5), F.col("ids")[0]), shards).cast("int"))
    index = dealt.groupBy("width", "shard").applyInPandas(_build, "width int, shard int, graph binary, sizes binary, ids binary, vectors binary")
    index = scratch.table(index, "index", "none")
    asking = usable(queries, id_col, vector_col).groupBy("id").agg(F.min("v").alias("v")).withColumn("width", F.size("v"))
    blocks = 1 + asking.count() // BLOCK_ROWS
    asking = asking.withColumn("block", F.pmod(F.xxhash64(F.lit(6), "id"), F.lit(blocks)).cast("int"))
    asking = asking.groupBy("width", "block").applyInPandas(_gather, "width int, block int, queries binary, asked binary")
    asked = scratch.table(asking.where(shards.isNotNull()), "asked", "none")
    # keys alone are repeated for each shard: what is exploded from one row is in memory at once, and the planner doesn't count it,
    # so without the hints it may send queries times shards to the driver as a broadcast
    meetings = asked.select("width", "block", F.explode(F.sequence(F.lit(0), shards - 1)).alias("shard"))
    met = meetings.join(asked.hint("merge"), ["width", "block"]).join(index.hint("merge"), ["width", "shard"])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # a row is a graph of megabytes
    try:
        found = scratch.table(met.mapInPandas(_searcher(k, ef), "query_id long, vec_id long, score double"), "found")
    finally:
        small_batches(spark)
    scratch.drop(index, asked, reps)
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))
