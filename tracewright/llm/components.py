"""Distributed union-find: connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Components of the undirected graph `edges(a, b)`.

    Returns `(id, comp)`, one row for each vertex that isn't the least of its
    component; `comp` is that least vertex.  Loops, repeated edges and edges with
    a null end count for nothing; an empty table gives an empty one.

    Each round hangs every vertex on the least one that it sees, first from the
    side of the larger neighbours, then of the smaller ones; the rounds grow with
    the logarithm of the longest path.  Hubs are only met in aggregates with
    partial sums and in equi-joins that adaptive execution can split.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, seen = scratch.table(e, "edges"), None
    while True:
        now = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if now["n"] == 0 or tuple(now) == seen:
            break
        seen = tuple(now)
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # written, so that adaptive execution can split a hub's side of the joins
        least = scratch.table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        nearest = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        small = large.join(nearest, "a").select(F.explode(pairs).alias("p")).select("p.a", "p.b").where("a <> b").distinct()
        following = scratch.table(small, "edges")
        scratch.drop(e, least)
        e = following
    return e.select(F.col("a").alias("id"), F.col("b").alias("comp"))
