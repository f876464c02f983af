"""Histograms, cumulative distributions and headroom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S

# The edges of the bins of sizes, as powers of two.
LOG2_EDGES = (0, 10, 20, 21, 22, 23, 64)


def bin_of(x: Column, edges: tuple[float, ...]) -> Column:
    """The bin's number from 0; the last bin is closed; null outside."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        upper = x <= edges[i + 1] if i == len(edges) - 2 else x < edges[i + 1]
        out = F.when((x >= edges[i]) & upper, F.lit(i)).otherwise(out)
    return out


def log2_histogram(df: DataFrame, size: Column, by: list[str], edges: tuple[float, ...] = LOG2_EDGES) -> DataFrame:
    """(by..., bin, n, share): how the logarithms of sizes are spread within each group."""
    binned = df.withColumn("bin", bin_of(F.when(size > 0, F.log2(size)), edges)).where("bin is not null")
    counted = binned.groupBy(*by, "bin").agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(*by)))


def cdf(df: DataFrame, size: str, by: list[str] | None = None, normalised: bool = True) -> DataFrame:
    """(by..., size, n, cumulative), led by the points (0, 0) and (least size, 0)."""
    by = by or []
    counted = df.groupBy(*by, F.col(size).alias("size")).agg(F.count("*").alias("n"))
    own = W.partitionBy(*by).orderBy("size").rowsBetween(W.unboundedPreceding, 0)
    total = F.sum("n").over(W.partitionBy(*by)) if normalised else F.lit(1)
    points = counted.withColumn("cumulative", F.sum("n").over(own).cast("double") / total.cast("double"))
    least = counted.groupBy(*by).agg(F.min("size").alias("size"))
    lead = lambda s: least.select(*by, s.cast(points.schema["size"].dataType).alias("size"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("cumulative"))
    return points.unionByName(lead(F.lit(0))).unionByName(lead(F.col("size")))


def split_cdfs(df: DataFrame, size: str, splits: dict[str, Column], normalised: bool = True) -> DataFrame:
    """A distribution for each named condition, in one pass; a row counts in every split that it meets."""
    names = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in splits.items()]), lambda x: x.isNotNull())
    return cdf(df.withColumn("split", F.explode(names)), size, ["split"], normalised)


def substituted_bounds(vertices: DataFrame, masked: Column, base: int, length: int) -> DataFrame:
    """Masked vertices with fixed bounds in place of their own; `substituted` says which."""
    m = F.coalesce(masked, F.lit(False))
    return vertices.withColumn("substituted", m).withColumn("base", F.when(m, F.lit(base)).otherwise(F.col("base"))).withColumn("length", F.when(m, F.lit(length)).otherwise(F.col("length")))


def power_bin(x: Column) -> Column:
    """0 for 0, else one more than the place of the highest bit: the bins 0, 1, 2-3, 4-7, ..."""
    return F.when(x <= 0, F.lit(0)).otherwise(F.length(F.bin(x.cast("bigint")))).cast("int")


def headroom(vertices: DataFrame, events: DataFrame, exact: bool = False) -> DataFrame:
    """(vid, head, tail, total, bin) of dereferenced pointers: what lies unused before and behind the accesses.

    The width of the last access is 32 for capabilities, else 8, 4 or 1 by
    whether the pointer also accessed just that far below it, else 8.
    """
    deref = S.EVENTS["deref_load"] | S.EVENTS["deref_store"]
    used = F.col("type").isin(S.EVENTS["deref_load"], S.EVENTS["deref_store"]) if exact else S.has_any(F.col("type"), deref)
    own = events.where(used).groupBy("vid").agg(F.min("addr").alias("lo"), F.max("addr").alias("hi"))
    widest = events.join(own, "vid").groupBy("vid", "lo", "hi").agg(
        F.max(S.has_any(F.col("type"), S.EVENTS["deref_is_cap"]) & (F.col("addr") == F.col("hi"))).alias("cap"),
        *[F.max(F.col("addr") == F.col("hi") - k).alias(f"m{k}") for k in (8, 4, 1)],
    )
    width = F.when(F.col("cap"), 32).when(F.col("m8"), 8).when(F.col("m4"), 4).when(F.col("m1"), 1).otherwise(8)
    joined = vertices.select("vid", "base", "length").join(widest, "vid").withColumn("top", F.col("base") + F.col("length"))
    out = joined.withColumn("end", F.least(F.col("hi") + width, F.col("top"))).select("vid", (F.col("lo") - F.col("base")).alias("head"), (F.col("top") - F.col("end")).alias("tail"))
    return out.withColumn("total", F.col("head") + F.col("tail")).withColumn("bin", power_bin(F.col("total")))


def bucket_counts(rooms: DataFrame) -> DataFrame:
    """(bin, n, least, most): how many pointers each headroom bin has, and its smallest and largest; the members are the rows of `headroom`."""
    return rooms.groupBy("bin").agg(F.count("*").alias("n"), F.min("total").alias("least"), F.max("total").alias("most"))


def bucket_functions(rooms: DataFrame, made_in: DataFrame, bucket: int) -> DataFrame:
    """(vid, total, address, t_alloc): the pointers of one bin with the address of the function that made them.  made_in: vid, address, t_alloc."""
    return rooms.where(F.col("bin") == bucket).select("vid", "total").join(made_in.select("vid", "address", "t_alloc"), "vid")


def bar_labels(bars: DataFrame, maps: DataFrame, start: str = "start") -> DataFrame:
    """Adds label: `(perms) name` of the mapping that begins there, else the address in hexadecimal.  maps: start, perm, path."""
    named = maps.where("path <> ''").groupBy(F.col("start").alias("_at")).agg(F.min(F.struct("perm", "path")).alias("_m"))
    text = F.concat(F.lit("("), F.trim("_m.perm"), F.lit(") "), S.basename(F.col("_m.path")))
    return bars.join(named, bars[start] == named["_at"], "left").withColumn("label", F.coalesce(text, S.hex_text(F.col(start)))).drop("_at", "_m")


def scaled(x: Column, exponent: int = -6) -> Column:
    """A number in another unit, a power of ten."""
    return x * F.lit(10.0**exponent)


def united_labels(*tables: DataFrame) -> DataFrame:
    """(at, label) of several tables: one label for each place, the first in order of its text."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy("at").agg(F.min("label").alias("label"))


def baseline_cdf(spark: SparkSession, step: int = 0x10000000000) -> DataFrame:
    """(size, n, cumulative) of pointers that all reach over the whole address space: one step."""
    return spark.createDataFrame([(0, 0, 0.0), (step, 0, 0.0), (step, 1, 1.0)], "size long, n long, cumulative double")


def stacked(histogram: DataFrame, by: list[str]) -> DataFrame:
    """Adds from and to: where each bin's bar begins and ends when a group's bars stand on each other."""
    own = W.partitionBy(*by).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    return histogram.withColumn("to", F.sum("n").over(own)).withColumn("from", F.col("to") - F.col("n"))
