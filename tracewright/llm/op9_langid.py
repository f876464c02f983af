"""Language ID by rank-order profiles.

A profile is the list of a language's most frequent character n-grams (1 to 3,
words in lower case with a blank on each side), most frequent first.  A text's
own list is compared with each profile by the out-of-place distance: the sum,
over the text's n-grams, of how far their ranks differ, with `TOP` for those that
the profile lacks.  The nearest language is predicted (ties: the first by name).

The score is 1 less the distance as a share of the largest possible one.  Texts
that are null or have no letter get `und` and score 0.  A letter is a character
of category L (`str.isalpha`): digits of all kinds, numerals such as "Ⅷ" or "½",
and marks alone are none.  Repeated rows are each predicted, alike; whole texts
count, however long; an empty table gives an empty one, and without labelled
texts every text is `und`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import crc_bucket, read, small_batches
from .splitting import code_points

GRAMS, TOP, LEARN_TEXTS = 3, 300, 2000
#: Below this share of the largest possible nearness a text is in none of the learned languages.
LEAST_SCORE = 0.2
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def gram_codes(text: str) -> np.ndarray:
    """A code for each n-gram of the text: three 21-bit characters, absent ones 0."""
    words = _NOT_LETTERS.sub(" ", text.lower()).strip()
    if not any(map(str.isalpha, words)):
        return np.zeros(0, np.uint64)
    c = code_points(f" {words} ").astype(np.uint64)
    two = (c[:-1] << np.uint64(21)) | c[1:]
    three = (two[:-1] << np.uint64(21)) | c[2:]
    # an n-gram doesn't reach beyond a word: its inner characters aren't blanks
    return np.concatenate([c[c != 32], two, three[c[1:-1] != 32]])


def top_grams(codes: np.ndarray, top: int = TOP) -> np.ndarray:
    """The most frequent codes, most frequent first, ties by a mix of the code."""
    grams, n = np.unique(codes, return_counts=True)
    if len(grams) > top:
        least = np.partition(n, len(n) - top)[len(n) - top]
        grams, n = grams[n >= least], n[n >= least]
    return grams[np.lexsort((grams * _MIX, -n))][:top]


class Profiles:
    def __init__(self, ranked: dict[str, np.ndarray], top: int = TOP):
        self.langs, self.top = sorted(ranked), top
        self.codes = np.unique(np.concatenate([np.zeros(0, np.uint64), *ranked.values()]))
        # the last column: n-grams of no profile
        self.ranks = np.full((len(self.langs), len(self.codes) + 1), -1, np.int32)
        for i, lang in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.codes, ranked[lang])] = np.arange(len(ranked[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        own = top_grams(gram_codes(text), self.top) if text else np.zeros(0, np.uint64)
        if not len(own) or not self.langs:
            return "und", 0.0
        at = np.searchsorted(self.codes, own)
        found = (at < len(self.codes)) & (self.codes[np.minimum(at, len(self.codes) - 1)] == own)
        ranks = self.ranks[:, np.where(found, at, len(self.codes))]
        places = np.where(ranks < 0, self.top, np.abs(ranks - np.arange(len(own), dtype=np.int32)))
        distance = places.sum(1)
        best = int(distance.argmin())
        return self.langs[best], 1.0 - float(distance[best]) / (self.top * len(own))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", texts: int = LEARN_TEXTS) -> Profiles:
    """Profiles from about `texts` labelled texts of each language (all, if fewer), taken by a hash of the key."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not sizes:
        return Profiles({})
    chance = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, texts / n))])
    draw = F.pmod(F.xxhash64(F.lit(9), F.col(key_col).cast("string")), F.lit(1 << 30)) / float(1 << 30)
    rows = rows.where(draw < chance[F.col(lang_col)]).selectExpr(f"`{lang_col}` as lang", f"`{text_col}` as text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, part in pdf.groupby("lang"):
                codes, n = np.unique(np.concatenate([gram_codes(x) for x in part["text"]]), return_counts=True)
                yield pd.DataFrame({"lang": lang, "code": codes.astype(np.int64), "n": n})

    small_batches(docs.sparkSession)
    counted = rows.mapInPandas(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "code"))
    kept = counted.withColumn("place", place).where(F.col("place") <= TOP).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "code"))).alias("top"))
    ranked = {}
    for lang, top in kept.collect():
        ranked[lang] = np.array([x["code"] for x in top], np.int64).astype(np.uint64)
    return Profiles(ranked)


def language_of(spark: SparkSession, profiles: Profiles):
    """A function of a text column whose result is the struct lang_pred, score."""
    model = spark.sparkContext.broadcast(profiles)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.value.predict(x) for x in texts], columns=["lang_pred", "score"])

    small_batches(spark)
    return predict


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """All columns of `docs` and lang_pred, score; a column of either name is replaced."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    out = docs.withColumn("__guess", language_of(docs.sparkSession, profiles)(F.col(text_col)))
    return out.select(*kept, "__guess.lang_pred", "__guess.score")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_bucket("doc_id", 4) == 2, F.lit(False))
    profiles = learn(docs.where(~held_out))
    return identify(docs.select("doc_id", "text", held_out.alias("held_out")), profiles).select("doc_id", "held_out", "lang_pred", "score")
