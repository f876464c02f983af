"""Interval algebra: unions, overlap counts, gaps, and the axis that shortens gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lookup import floor_lookup
from .scan import running


def union(df: DataFrame, start: str, end: str, by: list[str] | None = None) -> DataFrame:
    """Disjoint intervals that cover the same points; touching ones are merged."""
    by = by or []
    rows = running(df.select(*by, start, end), by, [start, end], _reach=("max", F.col(end), False))
    # where nothing before reaches, a new one begins; it ends with what lies before the next beginning reaches
    begun = rows.where(F.col("_reach").isNull() | (F.col(start) > F.col("_reach")))
    following = running(begun, by, [start], _until=("next", F.col("_reach")))
    whole = df.groupBy(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)]).agg(F.max(end).alias("_whole"))
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_b{i}"))
    return following.join(whole if by else F.broadcast(whole), same).select(*by, start, F.coalesce("_until", "_whole").alias(end))


def sweep(df: DataFrame, start: str, end: str, by: list[str] | None = None) -> DataFrame:
    """Disjoint ranges [start, end) with how many intervals cover each; ranges that none covers are left out."""
    by = by or []
    edges = df.select(*by, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("step")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("step")))).alias("e"))
    points = edges.groupBy(*by, "e.at").agg(F.sum("e.step").alias("step"))
    counted = running(points, by, ["at"], n=("sum", F.col("step")), until=("next", F.col("at")))
    return counted.where("n > 0").select(*by, F.col("at").alias(start), F.col("until").alias(end), "n")


def gaps(df: DataFrame, start: str, end: str, by: list[str] | None = None) -> DataFrame:
    """What lies between disjoint intervals."""
    by = by or []
    return running(df.select(*by, start, end), by, [start], gap_start=("last", F.col(end), False)).select(*by, "gap_start", F.col(start).alias("gap_end")).where("gap_end > gap_start")


def segments(df: DataFrame, start: str, end: str, by: list[str] | None = None, share: float = 0.05) -> DataFrame:
    """Kept intervals and gaps in order, with the place `x0` where each begins on an axis that shrinks gaps to `share` of what is kept."""
    by = by or []
    kept = union(df, start, end, by).select(*by, F.col(start).alias("from"), F.col(end).alias("to"), F.lit(True).alias("kept"))
    omitted = gaps(kept, "from", "to", by).select(*by, F.col("gap_start").alias("from"), F.col("gap_end").alias("to"), F.lit(False).alias("kept"))
    all_ = kept.unionByName(omitted).withColumn("size", F.col("to") - F.col("from"))
    of = lambda kept: F.coalesce(F.sum(F.when(F.col("kept") == kept, F.col("size"))), F.lit(0))
    sums = all_.groupBy(*by).agg(of(True).alias("_keep"), of(False).alias("_omit"))
    both = all_.join(sums, by) if by else all_.join(F.broadcast(sums), F.lit(True))
    scale = F.when(F.col("kept"), F.lit(1.0)).otherwise(F.coalesce(F.try_divide(F.lit(share) * F.col("_keep"), F.col("_omit")), F.lit(1.0)).cast("double"))
    scaled = both.withColumn("scale", scale).drop("_keep", "_omit")
    placed = running(scaled, by, ["from"], x0=("sum", F.col("size") * F.col("scale"), False))
    return placed.withColumn("x0", F.coalesce("x0", F.lit(0.0)))


def to_axis(points: DataFrame, axis: DataFrame, value: str) -> DataFrame:
    """Each point's place `x` on the axis of `segments` (one axis); null beyond its ends."""
    steps = axis.select(F.col("from").cast("double").alias("_from"), F.col("from").cast("double").alias("_a"), F.col("to").cast("double").alias("_to"), "x0", "scale")
    found = floor_lookup(points, steps, value, "_from", ["_a", "_to", "x0", "scale"], 1.0)
    x = F.when(F.col(value) < F.col("_to"), F.col("x0") + (F.col(value) - F.col("_a")) * F.col("scale"))
    return found.withColumn("x", x).drop("_a", "_to", "x0", "scale")


def from_axis(points: DataFrame, axis: DataFrame, x: str) -> DataFrame:
    """The value at each place of the axis."""
    steps = axis.select("x0", F.col("x0").alias("_x0"), F.col("from").alias("_from"), "scale", (F.col("x0") + F.col("size") * F.col("scale")).alias("_x1"))
    found = floor_lookup(points, steps, x, "x0", ["_x0", "_from", "scale", "_x1"], 1.0)
    value = F.when(F.col(x) < F.col("_x1"), F.col("_from") + (F.col(x) - F.col("_x0")) / F.col("scale"))
    return found.withColumn("value", value).drop("_x0", "_from", "scale", "_x1")


def ends_of_large(df: DataFrame, start: str, end: str, edge: int = 1 << 12) -> DataFrame:
    """The ranges without repeats; one longer than two edges is replaced by its two ends."""
    pair = lambda a, b: F.struct(a.alias(start), b.alias(end))
    large = F.col(end) - F.col(start) > 2 * edge
    parts = F.when(large, F.array(pair(F.col(start), F.col(start) + edge), pair(F.col(end) - edge, F.col(end)))).otherwise(F.array(pair(F.col(start), F.col(end))))
    return df.select(F.explode(parts).alias("r")).select("r.*").distinct()


def lifetimes(df: DataFrame, time: str, by: list[str], order: list[str], open_end: Column | None = None) -> DataFrame:
    """When each version of a place ends: at the next one, or the open mark (-1)."""
    own = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("t_free", F.coalesce(F.lead(time).over(own), F.lit(-1) if open_end is None else open_end))
