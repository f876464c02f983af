"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text falls into one of at most `BINS` bins; a table holds the
contribution of each bin to the log-odds.  The tables are learned by cyclic
boosting: round after round, one shallow tree per feature is fitted to the
gradients by bin and added to that feature's table at a small rate.  Then the
pairs of features with the strongest remaining interaction get tables over two
sets of bins, boosted likewise with trees of one cut on each side.  A score is
the logistic function of the tables' sums, looked up for whole batches.

A null text counts as empty; an empty text has a score like any other.  Without
labels of both kinds the score is their share, or 0.5 without labels.  Repeated
rows are each scored, alike; of documents with one id, a label is learned with
one, so no more than the bounded number of labels reaches the driver.  Ties among
splits and pairs go to the first feature, equal labels of one document count each.
An empty table gives an empty one; only the id and the text are read for a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_bucket, read, small_batches
from .splitting import code_points

TRAIN_ROWS, BINS, COARSE, ROUNDS, RATE, PAIRS, PAIR_ROUNDS = 20_000, 32, 8, 150, 0.1, 8, 40
FEATURES = (
    "chars", "words", "word_length", "capitals", "digits", "signs", "symbols", "exclamations", "blanks", "beyond_ascii",
    "distinct_words", "commonest_word", "short_words", "long_words", "capital_words", "lines", "line_length", "repeated_lines", "ended_lines", "links",
)

#: Classes of the characters below 0x250: 1 small letters, 2 capitals, 3 digits, 4 other signs, 5 symbols, 6 exclamation, 7 white space.
_CLASSES = np.array([2 if chr(c).isupper() else 1 if chr(c).isalpha() else 3 if chr(c).isdigit() else 7 if chr(c).isspace() else 6 if chr(c) in "!?" else 5 if chr(c) in "#*$%&|<>{}[]=+~^@\\/_" else 4 for c in range(0x250)], np.uint8)


def features(text: str | None) -> list[float]:
    text = text or ""
    codes = code_points(text)
    n = max(len(codes), 1)
    kinds = np.bincount(_CLASSES[np.minimum(codes, 0x24F)], minlength=8) if len(codes) else np.zeros(8, np.int64)
    words = text.split()
    w = max(len(words), 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    own: dict[str, int] = {}
    for x in words:
        own[x] = own.get(x, 0) + 1
    lines = [x for x in text.split("\n") if x.strip()]
    m = max(len(lines), 1)
    letters = max(int(kinds[1] + kinds[2]), 1)
    return [
        np.log1p(len(codes)), np.log1p(len(words)), float(sizes.sum()) / w, kinds[2] / letters, kinds[3] / n, kinds[4] / n, kinds[5] / n, kinds[6] / n, kinds[7] / n, float((codes > 127).sum()) / n,
        len(own) / w, max(own.values(), default=0) / w, float((sizes <= 3).sum()) / w, float((sizes > 15).sum()) / w, sum(map(str.isupper, words)) / w,
        np.log1p(len(lines)), np.log1p(len(codes) / m), 1 - len(set(lines)) / m, sum(x.rstrip()[-1:] in ".!?:\"'" for x in lines) / m, text.count("://") / w,
    ]


def _best_cuts(g: np.ndarray, h: np.ndarray, leaves: int = 4) -> np.ndarray:
    """The step of each bin under a tree that cuts ordered bins into at most `leaves` runs."""
    runs, step = [(0, len(g))], np.zeros(len(g))

    def cut(a: int, b: int) -> tuple[float, int]:
        left_g, left_h = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
        if not len(left_g):
            return 0.0, a
        all_g, all_h = g[a:b].sum(), h[a:b].sum()
        gain = left_g**2 / (left_h + 1) + (all_g - left_g) ** 2 / (all_h - left_h + 1) - all_g**2 / (all_h + 1)
        i = int(gain.argmax())
        return float(gain[i]), a + i + 1

    while len(runs) < leaves:
        gain, at, k = max((*cut(*r), -i) for i, r in enumerate(runs))
        if gain <= 1e-9:
            break
        a, b = runs[-k]
        runs[-k : -k + 1] = [(a, at), (at, b)]
    for a, b in runs:
        step[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return step


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and step of the best tree with one cut on each axis of a grid."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a, ah = cg[:-1, :-1], ch[:-1, :-1]
    if not a.size:
        return 0.0, np.zeros_like(g)
    rg, rh, dg, dh = cg[:-1, -1:], ch[:-1, -1:], cg[-1:, :-1], ch[-1:, :-1]
    parts = ((a, ah), (rg - a, rh - ah), (dg - a, dh - ah), (cg[-1, -1] - rg - dg + a, ch[-1, -1] - rh - dh + ah))
    gain = sum(x**2 / (y + 1) for x, y in parts) - cg[-1, -1] ** 2 / (ch[-1, -1] + 1)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    step = np.empty_like(g)
    for (x, y), rows, cols in zip(parts, ((0, i + 1), (0, i + 1), (i + 1, None), (i + 1, None)), ((0, j + 1), (j + 1, None), (0, j + 1), (j + 1, None)), strict=True):
        step[slice(*rows), slice(*cols)] = x[i, j] / (y[i, j] + 1)
    return float(gain[i, j]), step


class AdditiveModel:
    """Tables by feature and by pair of features; `fit` learns them, `score` sums them."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        n, k = x.shape
        share = float(y.mean()) if n else 0.5
        self.base = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.zeros(0) for f in range(k)]
        self.coarse = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, COARSE + 1)[1:-1])) if n else np.zeros(0) for f in range(k)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        if not n or share in (0.0, 1.0):
            return self
        bins = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)]
        total = np.full(n, self.base)
        p = lambda: 1 / (1 + np.exp(-total))
        for _ in range(ROUNDS):
            for f in range(k):
                q, m = p(), len(self.tables[f])
                step = RATE * _best_cuts(np.bincount(bins[f], y - q, m), np.bincount(bins[f], q * (1 - q), m))
                self.tables[f] += step
                total += step[bins[f]]
        grid = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.coarse)]

        def grids(f: int, g: int) -> tuple[np.ndarray, tuple[float, np.ndarray]]:
            shape = (len(self.coarse[f]) + 1, len(self.coarse[g]) + 1)
            at, q = grid[f] * shape[1] + grid[g], p()
            return at, _quadrants(*(np.bincount(at, v, shape[0] * shape[1]).reshape(shape) for v in (y - q, q * (1 - q))))

        ranked = sorted(((grids(f, g)[1][0], f, g) for f, g in combinations(range(k), 2)), key=lambda r: (-r[0], r[1:]))
        self.pairs = [(f, g, np.zeros((len(self.coarse[f]) + 1, len(self.coarse[g]) + 1))) for gain, f, g in ranked[:PAIRS] if gain > 1e-6]
        for _ in range(PAIR_ROUNDS):
            for f, g, table in self.pairs:
                at, (_, step) = grids(f, g)
                table += RATE * step
                total += RATE * step.ravel()[at]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, f], "right")]
        for f, g, table in self.pairs:
            total += table[np.searchsorted(self.coarse[f], x[:, f], "right"), np.searchsorted(self.coarse[g], x[:, g], "right")]
        return 1 / (1 + np.exp(-total))


def _matrix(texts: pd.Series) -> np.ndarray:
    return np.array([features(x) for x in texts], np.float64).reshape(len(texts), len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", key_col: str = "doc_id", label_col: str = "quality", rows: int = TRAIN_ROWS) -> AdditiveModel:
    """A model from at most `rows` labels, the first by a hash of the key, whose documents are in `docs`."""
    drawn = labels.where(F.col(label_col).isNotNull() & F.col(key_col).isNotNull()).select(F.col(key_col).alias("_key"), F.col(label_col).alias("_label"))
    drawn = drawn.orderBy(F.xxhash64(F.lit(2), F.col("_key").cast("string")), "_key", "_label").limit(rows)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"x": list(_matrix(pdf["text"])), "_place": pdf["_place"], "_label": pdf["_label"].astype("float64")})

    small_batches(docs.sparkSession)
    drawn = drawn.withColumn("_place", F.monotonically_increasing_id())
    joined = docs.join(F.broadcast(drawn), docs[key_col] == drawn["_key"]).select(F.col(text_col).alias("text"), "_place", "_label")
    each = joined.mapInPandas(measure, "x array<double>, _place long, _label double")
    got = each.groupBy("_place", "_label").agg(F.min("x").alias("x")).toPandas()
    x = np.array(got["x"].tolist(), np.float64).reshape(len(got), len(FEATURES))
    order = np.lexsort((*x.T, got["_label"])) if len(got) else []
    return AdditiveModel().fit(x[order], got["_label"].to_numpy()[order])


def score(docs: DataFrame, model: AdditiveModel, text_col: str = "text") -> DataFrame:
    """All columns of `docs` and score; a column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(_matrix(texts)))

    small_batches(docs.sparkSession)
    return docs.withColumn("score", scored(F.col(text_col)))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = F.coalesce(crc_bucket("doc_id", 3) == 1, F.lit(False))
    model = train(docs.where(~held_out), labels.where(~held_out))
    out = score(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
