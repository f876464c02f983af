"""Running aggregates along an order, without one task for the whole order or for one key.

The rows are dealt to tasks by ranges of key and order.  A task aggregates along its
own range; what the ranges before it (or after it) hold comes from a table with a row
for each range and key.  Any aggregate whose parts can be put together will do, so
results don't depend on how the rows are dealt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import written

#: Names of aggregates: what a range gives (of values and places), along rows, and with what was before.
_PLAIN = {"sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)), "max": (F.max, F.greatest), "min": (F.min, F.least)}


def running(df: DataFrame, by: list[str], order: list[Column | str], **adds: tuple[str, Column] | tuple[str, Column, bool]) -> DataFrame:
    """Adds for each name (kind, value, or kind, value, False) an aggregate over the key's rows up to each row, or up to the one before.

    kind: sum, max or min of the values that aren't null; last, the last such value;
    next, the first such value in the rows after (from the row itself on, if the
    third entry is True); null where there is none.  Nulls come first in the order.
    Rows that are equal in the order follow each other in any one order.  Only one
    pass deals the rows, whatever the number of columns.
    """
    names = {c: f"_r{i}" for i, c in enumerate(adds)}
    by_range = [F.col(c) for c in by] + [F.col(c).asc_nulls_first() if isinstance(c, str) else c for c in order]
    rows = df.select("*", *[value.alias(names[c]) for c, (_, value, *_) in adds.items()], F.monotonically_increasing_id().alias("_tie"))
    dealt = rows.repartitionByRange(*by_range, F.col("_tie")).sortWithinPartitions(*by_range, F.col("_tie")).drop("_tie")
    dealt = written(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id()))
    own = W.partitionBy(*by, "_part").orderBy("_seq")
    parts = W.partitionBy(*by).orderBy("_part")
    inner, held, carried, out = {}, [], [], {}
    for c, (kind, _, *through) in adds.items():
        v, known = F.col(names[c]), F.col(names[c]).isNotNull()
        if kind == "next":
            from_, to = 0 if through and through[0] else 1, W.unboundedFollowing
            along, part, after = F.first(v, ignorenulls=True), F.min_by(v, F.when(known, F.col("_seq"))), parts.rowsBetween(1, W.unboundedFollowing)
            across, both = F.first(F.col(f"{names[c]}p"), ignorenulls=True), F.coalesce
        else:
            from_, to = W.unboundedPreceding, -1 if through and not through[0] else 0
            after = parts.rowsBetween(W.unboundedPreceding, -1)
            if kind == "last":
                along, part = F.last(v, ignorenulls=True), F.max_by(v, F.when(known, F.col("_seq")))
                across, both = F.last(F.col(f"{names[c]}p"), ignorenulls=True), F.coalesce
            else:
                f, both = _PLAIN[kind]
                along, part, across = f(v), f(v), f(F.col(f"{names[c]}p"))
        inner[f"{names[c]}o"] = along.over(own.rowsBetween(from_, to))
        held.append(part.alias(f"{names[c]}p"))
        carried.append(across.over(after).alias(f"{names[c]}b"))
        out[c] = both(F.col(f"{names[c]}o"), F.col(f"{names[c]}b"))
    summary = dealt.groupBy(*by, "_part").agg(*held).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_part").alias("_kp"), *carried)
    found = dealt.withColumns(inner)
    same = (F.col("_part") == F.col("_kp"))
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return found.join(summary, same).select(*[F.col(f"`{c}`") for c in df.columns], *[x.alias(c) for c, x in out.items()])
