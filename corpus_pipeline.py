"""A training corpus out of `documents`: stages of operators, each on what the one before kept.

Every stage is written as Parquet and read again for the next.  Rows with a null
text, or one without a letter (an empty one too), go at the first stage.  A text's
n_chars follows its text.  Columns beyond those of `documents` pass through all but
the last stage, whatever their names.  Repeated rows are documents of their own at
every stage.  Ties: of like lines or documents the one with the least doc_id stays
(nulls first among lines, last among documents), then the first read.  An empty
table gives an empty one at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import Scratch, crc_bucket, small_batches, smaller_side
from tracewright.llm.op1_line_dedup import without_repeated_lines
from tracewright.llm.op5_packing import pack_documents
from tracewright.llm.op6_rules import rules_of
from tracewright.llm.op7_jaccard import similar_texts
from tracewright.llm.op9_langid import LEAST_SCORE, language_of, learn


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in one of the labelled languages."""
    profiles = learn(docs.where(F.coalesce(crc_bucket("doc_id", 4) != 2, F.lit(True))))
    guessed = docs.withColumn("__language", language_of(spark, profiles)(F.col("text")))
    return guessed.where((F.col("__language.lang_pred") != "und") & (F.col("__language.score") >= LEAST_SCORE)).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass the base rules and the repetition rules."""
    small_batches(spark)
    return docs.withColumn("__rules", rules_of(F.col("text"))).where("__rules.kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one line of each component of near-equal lines; documents without a line left go."""
    out = without_repeated_lines(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of similar texts: that of the least doc_id, nulls last, then of the least key of its own."""
    scratch = Scratch(spark, "kept")
    rows = scratch.table(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    classes = scratch.table(similar_texts(rows, id_col="__row", count_links=False).withColumnRenamed("doc_id", "__row"), "classes")
    several = classes.where("__row <> class_id").select("class_id").distinct()
    members = classes.join(several, "class_id", "left_semi").join(rows.select("__row", "doc_id"), "__row")
    kept = members.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row"))["__row"].alias("__kept"))
    gone = scratch.table(members.join(kept, "class_id").where("__row <> __kept").select(F.col("__row").alias("__gone")), "gone")
    gone = smaller_side(gone)
    return rows.join(gone, rows["__row"] == gone["__gone"], "left_anti").select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of tokens: a row per piece."""
    return pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express rank-order profiles, suffix arrays, MinHash components or packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
