"""Whitening of embeddings: exact integer moments by digit-slice products, then an eigendecomposition.

1. Entries become integers, floor(256 c); each distinct vector of integers is in
   the fit list once.
2. Each task multiplies limbs of its vectors with float64 BLAS, exactly, and puts
   them together as big integers; numbers, sums and products of all tasks are added
   limb by limb in Spark.  What leaves a task is a matrix, whatever its rows.
3. n times the products less the outer product of the sums is n^2 times the
   covariance, an exact matrix of integers; its leading eigenvectors are found to
   more than double precision, however unlike the eigenvalues are.
4. A pass over the fit list measures the covariance of what comes out.

Rows whose vector is null, empty, or holds a null or a number that isn't finite are
dropped.  Vectors of each length are whitened apart from those of others.  Entries
beyond the range of a long take its ends.  Null ids are kept, as are rows that
repeat others: each row gives its own components, no more than its vector is long.
A component without variance (as of vectors that are all equal) has a null
`whitened`, `explained` 0, and no part in `identity_error`.  A `deviation` beyond
the range of a long is null, and its digits are in `deviation_digits`.  An empty
table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import digits
from .common import Scratch, read

SCALE, COMPONENTS = 256.0, 4
#: Limbs in which sums travel: so many that 2^23 tasks can be added.
SENT = 40
#: Above this bound on rounding, relative to a component's deviation, a row is projected in integers.
ROUNDING = 2.0**-36
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_digits string"


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = SCALE) -> DataFrame:
    """(vec_id, x): the vectors that take part, as integers."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("v is not null and size(v) > 0")
    rows = rows.where(~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * scale)).alias("x"))


def _by_width(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) for each length of the lists."""
    offsets = np.asarray(column.offsets)
    values, sizes = np.asarray(column.values), np.diff(offsets)
    for width in np.unique(sizes):
        at = np.flatnonzero(sizes == width)
        yield at, values[offsets[at][:, None] + np.arange(width)]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (width, cell, limb, v): the cells of a task's matrix on and above the diagonal, in limbs."""
    grams: dict[int, digits.Gram] = {}
    for batch in batches:
        for _, x in _by_width(batch.column("x")):
            grams.setdefault(x.shape[1], digits.Gram(x.shape[1])).add(x)
    for width, gram in grams.items():
        at = np.flatnonzero(np.triu(np.ones((width + 1, width + 1), bool)).ravel())
        left, limb, mask = gram.settle().ravel()[at], 0, (1 << SENT) - 1
        while left.any():
            low = left & mask
            # the sign stays with what is left until that is nothing but the sign
            rest = left >> SENT
            ends = (rest == -1) | (rest == 0)
            v = np.where(ends, left, low).astype(np.int64)
            some = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), width, np.int32)), pa.array(at[some]), pa.array(np.full(len(some), limb, np.int32)), pa.array(v[some])], ["width", "cell", "limb", "v"])
            left, limb = np.where(ends, 0, rest), limb + 1


def _fitter(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        width = int(pdf["width"].iloc[0])
        flat = np.zeros((width + 1) ** 2, object)
        for cell, limb, v in zip(pdf["cell"].tolist(), pdf["limb"].tolist(), pdf["v"].tolist(), strict=True):
            flat[cell] += v << (SENT * limb)
        upper = flat.reshape(width + 1, width + 1)
        n, s, g = int(upper[0, 0]), upper[0, 1:], upper[1:, 1:]
        m = n * (g + np.triu(g, 1).T) - np.outer(s, s)
        values, vectors, bits = digits.leading(m, k)
        trace = int(m.trace())
        row = {
            "width": width, "n": n, "sums": [str(x) for x in s], "bits": bits,
            "components": [str(x) for i in range(len(values)) for x in vectors[:, i]],
            "deviations": [float(np.sqrt(digits.ratio(x, n * n << bits))) for x in values],
            "explained": [digits.ratio(x, trace << bits) if trace else 0.0 for x in values],
        }
        return pd.DataFrame([row])

    return run


class Model:
    """What a task needs to whiten vectors of one length."""

    def __init__(self, row, error: float | None = None):
        self.n, self.bits, self.error = row["n"], row["bits"], error
        self.sums = np.array([int(x) for x in row["sums"]], object)
        self.floors = self.sums // self.n
        self.rests = np.array([digits.ratio(x % self.n, self.n) for x in self.sums])
        self.fixed = np.array([int(x) for x in row["components"]], object).reshape(-1, len(self.sums)).T
        self.vectors = np.array([[digits.ratio(x, 1 << self.bits) for x in y] for y in self.fixed])
        self.sigmas, self.explained = np.array(row["deviations"]), np.array(row["explained"])
        self.real = self.sigmas > 0

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """(x - S/n) on each component over its deviation; NaN where that is 0."""
        out = np.full((len(x), len(self.sigmas)), np.nan)
        if not self.real.any():
            return out
        sigmas = self.sigmas[self.real]
        least, most = int(x.min()), int(x.max())
        far = np.ones(len(x), bool)
        if -(2**61) < least and most < 2**61:
            y = (x - self.floors.astype(np.int64)).astype(np.float64) - self.rests
            far = np.abs(y).max(1) * x.shape[1] * 2.0**-52 > ROUNDING * sigmas.min()
            out[:, self.real] = y @ self.vectors[:, self.real] / sigmas
        if far.any():
            exact = digits.product(x[far].astype(object) * self.n - self.sums, self.fixed[:, self.real])
            scale = self.n << self.bits
            out[np.ix_(far, self.real)] = np.frompyfunc(lambda v: digits.ratio(v, scale), 1, 1)(exact).astype(np.float64) / sigmas
        return out

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """The sum over dimensions of (n x - S)^2, as Python integers."""
        if max(abs(int(x.min())), abs(int(x.max()))) < 2**26:
            squares = (x * x).sum(1).astype(object)
        else:
            squares = (x.astype(object) ** 2).sum(1)
        crossed = digits.product(x, self.sums[:, None])[:, 0]
        return self.n * self.n * squares - 2 * self.n * crossed + int((self.sums**2).sum())


def _whitener(models):
    """Batches of x to batches (width, w)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in _by_width(batch.column("x")):
                w = models.value[x.shape[1]].whiten(x)
                flat = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), x.shape[1], np.int32)), lists], ["width", "w"])

    return run


def _answers(models):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _by_width(batch.column("x")):
                model = models.value[x.shape[1]]
                w, deviation = model.whiten(x), model.deviation(x)
                fits = deviation <= 2**63 - 1
                short = pa.array([v if ok else None for v, ok in zip(deviation, fits, strict=True)], pa.int64())
                text = pa.array([None if ok else str(v) for v, ok in zip(deviation, fits, strict=True)], pa.string())
                k = w.shape[1]
                w, each = w.ravel(), pa.array(np.repeat(np.arange(len(x)), k))
                rows = len(x) * k
                columns = [
                    batch.column("vec_id").take(pa.array(at)).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(rows, model.n)), short.take(each),
                    pa.array(w, mask=np.isnan(w)), pa.array(np.tile(model.explained, len(x))), pa.array(np.full(rows, model.error)), text.take(each),
                ]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in RESULT.split(", ")])

    return run


def fit(rows: DataFrame, scratch: Scratch, k: int = COMPONENTS) -> dict[int, Model]:
    """A model for each length of the vectors (vec_id, x): k * length numbers, all that the driver holds."""
    spark = rows.sparkSession
    listed = scratch.table(rows.select("x").distinct(), "fit")
    sums = listed.mapInArrow(_sums, "width int, cell long, limb int, v long").groupBy("width", "cell", "limb").agg(F.sum("v").alias("v"))
    kind = "width int, n long, sums array<string>, bits int, components array<string>, deviations array<double>, explained array<double>"
    fitted = {r["width"]: r for r in sums.groupBy("width").applyInPandas(_fitter(k), kind).collect()}
    held = spark.sparkContext.broadcast({w: Model(r) for w, r in fitted.items()})
    whitened = listed.mapInArrow(_whitener(held), "width int, w array<double>")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    measured = whitened.groupBy("width").agg(*[F.abs(F.covar_pop(F.get("w", F.lit(i)), F.get("w", F.lit(j))) - float(i == j)).alias(f"c{i}_{j}") for i, j in pairs])
    errors = {r["width"]: max((x for x in r[1:] if x is not None), default=0.0) for r in measured.collect()} if fitted else {}
    scratch.drop(listed)
    return {w: Model(r, errors[w]) for w, r in fitted.items()}


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """A row for each vector that takes part and each of its first k components; the columns of RESULT."""
    rows = integers(vectors, id_col, vector_col)
    models = fit(rows, Scratch(vectors.sparkSession, "whitening"), k)
    return rows.mapInArrow(_answers(vectors.sparkSession.sparkContext.broadcast(models)), RESULT)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"))
