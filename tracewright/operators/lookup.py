"""Lookups by order and by range: as-of joins, floor lookups, points in intervals, overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions import scalars as S
from .scan import running
from .storage import to_join, written


def as_of(left: DataFrame, right: DataFrame, by: list[str], on: str, take: list[str], forward: bool = False, strict: bool = False) -> DataFrame:
    """Each left row with the columns `take` of the nearest right row before it (after it, if `forward`).

    Both sides have `by` and `on`; a right row at the same place counts unless
    `strict`.  One union, one shuffle by `by`, one ordered frame: no join.
    """
    tags = {"left": 1, "right": 0 if not strict else 2}
    if forward:
        tags["right"] = 2 if not strict else 0
    l = left.select("*", F.lit(None).cast(right.select(F.struct(*take)).schema[0].dataType).alias("_right"), F.lit(tags["left"]).alias("_tag"))  # noqa: E741
    r = right.select(*by, on, F.struct(*take).alias("_right"), F.lit(tags["right"]).alias("_tag"))
    both = l.unionByName(r, allowMissingColumns=True)
    own = W.partitionBy(*by).orderBy(on, "_tag")
    if forward:
        found = F.first("_right", ignorenulls=True).over(own.rowsBetween(1, W.unboundedFollowing))
    else:
        found = F.last("_right", ignorenulls=True).over(own.rowsBetween(W.unboundedPreceding, -1))
    out = both.withColumn("_found", found).where(F.col("_tag") == tags["left"])
    return out.select(*left.columns, *[F.col(f"_found.{c}").alias(c) for c in take])


def as_of_chunked(left: DataFrame, right: DataFrame, by: list[str], on: str, take: list[str], width: float, strict: bool = False) -> DataFrame:
    """`as_of` backward where single keys hold very many rows.

    Rows are dealt to chunks of `width` along `on`, so a key is spread over tasks.
    A row is found in its own chunk, or else is the last one of the chunks before,
    which a table with a row per key and chunk tells.
    """
    chunk = F.floor(F.col(on) / width).cast("long")
    points = left.withColumn("_chunk", chunk)
    names = [f"_t_{c}" for c in take]
    rows = right.select(*by, on, chunk.alias("_chunk"), *[F.col(c).alias(n) for c, n in zip(take, names, strict=True)], F.lit(True).alias("_own"))
    inner = as_of(points, rows, [*by, "_chunk"], on, [*names, "_own"], strict=strict)
    last = rows.groupBy(*by, "_chunk").agg(F.max_by(F.struct(*names), on).alias("_last"))
    chunks = last.unionByName(points.select(*by, "_chunk").distinct(), allowMissingColumns=True).groupBy(*by, "_chunk").agg(F.max("_last").alias("_last"))
    before = F.last("_last", ignorenulls=True).over(W.partitionBy(*by).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1))
    joined = inner.join(chunks.select(*by, "_chunk", before.alias("_before")), [*by, "_chunk"], "left")
    return joined.select(*left.columns, *[F.when(F.col("_own"), F.col(n)).otherwise(F.col(f"_before.{n}")).alias(c) for c, n in zip(take, names, strict=True)])


def with_next(df: DataFrame, by: list[str], on: str, take: dict[str, str], width: float) -> DataFrame:
    """Adds the columns `take` (new name: column) of the key's next row along `on`, null for its last.

    For keys with very many rows: a row looks in its own chunk of `width`; the
    last one of a chunk takes the first row of the key's next chunk, which a table
    with a row per key and chunk tells.
    """
    chunk = F.floor(F.col(on) / width).cast("long")
    held = F.struct(*[F.col(c).alias(n) for n, c in take.items()])
    rows = df.withColumn("_chunk", chunk).withColumn("_held", held)
    ends = rows.groupBy(*by, "_chunk").agg(F.min_by("_held", on).alias("_first"))
    coming = ends.select(*by, "_chunk", F.lead("_first").over(W.partitionBy(*by).orderBy("_chunk")).alias("_coming"))
    inner = rows.withColumn("_next", F.lead("_held").over(W.partitionBy(*by, "_chunk").orderBy(on)))
    joined = inner.join(coming, [*by, "_chunk"], "left").withColumn("_next", F.coalesce("_next", "_coming"))
    return joined.select(*df.columns, *[F.col(f"_next.{n}").alias(n) for n in take])


def with_running_sum(df: DataFrame, by: list[str], on: str, value: str, name: str, width: float) -> DataFrame:
    """Adds the sum of `value` over the key's rows up to each, along `on`; chunks as in `with_next`."""
    rows = df.withColumn("_chunk", F.floor(F.col(on) / width).cast("long"))
    sums = rows.groupBy(*by, "_chunk").agg(F.sum(value).alias("_sum"))
    before = sums.select(*by, "_chunk", F.coalesce(F.sum("_sum").over(W.partitionBy(*by).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inner = rows.withColumn("_own", F.sum(value).over(W.partitionBy(*by, "_chunk").orderBy(on).rowsBetween(W.unboundedPreceding, 0)))
    return inner.join(before, [*by, "_chunk"]).withColumn(name, F.col("_own") + F.col("_before")).select(*df.columns, name)


#: A cell of one level is so many of the level below; an interval is entered at the level where it meets at most one more cell than that.
FAN, FAN_BITS = 16, 4


class Cells:
    """Cells of `width` and of FAN, FAN^2... times it.  Whole numbers are dealt to them by their bits, exactly over all 64, others by division."""

    def __init__(self, width: float, whole: bool):
        self.whole, self.bits = whole, max(int(width) - 1, 0).bit_length()
        self.width = float(1 << self.bits) if whole else float(width)

    def level(self, start: Column, end: Column) -> Column:
        """The level whose cells are about as wide as the interval's sixteenth or wider."""
        cells = F.greatest((end.cast("double") - start.cast("double")) / self.width, F.lit(1.0))
        found = F.greatest(F.ceil(F.log(cells) / F.log(F.lit(float(FAN)))) - 1, F.lit(0)).cast("int")
        return F.least(found, F.lit((63 - self.bits) // FAN_BITS)) if self.whole else found

    def cell(self, value: Column, level: Column) -> Column:
        if self.whole:
            return F.call_function("shiftright", value.cast("long"), (level * FAN_BITS + self.bits).cast("int"))
        return F.floor(value / (F.lit(self.width) * F.pow(F.lit(float(FAN)), level.cast("double")))).cast("long")

    def spots(self, start: Column, end: Column, level: Column) -> Column:
        """The cells of a level that an interval meets."""
        return F.transform(F.sequence(self.cell(start, level), self.cell(end, level)), lambda c: F.struct(level.alias("_level"), c.alias("_cell")))

    def looks(self, value: Column, levels: list[int]) -> Column:
        """A point's cell at each level."""
        return F.array(*[F.struct(F.lit(x).alias("_level"), self.cell(value, F.lit(x)).alias("_cell")) for x in levels or [0]])

    def levels(self, df: DataFrame, start: str, end: str) -> list[int]:
        """The levels at which the intervals of a table are: at most 16 numbers."""
        return sorted(r[0] for r in df.select(self.level(F.col(start), F.col(end)).alias("l")).where("l is not null").distinct().collect())


def _whole(*columns: tuple[DataFrame, str]) -> bool:
    return all(isinstance(df.schema[c].dataType, IntegralType) for df, c in columns)


def with_following(df: DataFrame, on: str, name: str) -> DataFrame:
    """Adds the next greater value of `on` in the table, whose values differ; null for the last.  By ranges of rows, so it doesn't matter how the values lie."""
    dealt = written(df.repartitionByRange(on).withColumn("_part", F.spark_partition_id()))
    firsts = dealt.groupBy("_part").agg(F.min(on).alias("_first"))
    coming = firsts.select("_part", F.lead("_first").over(W.orderBy("_part")).alias("_coming"))
    inner = dealt.withColumn(name, F.lead(on).over(W.partitionBy("_part").orderBy(on)))
    return inner.join(coming, "_part").withColumn(name, F.coalesce(name, "_coming")).drop("_part", "_coming")


def floor_lookup(left: DataFrame, table: DataFrame, value: str, key: str, take: list[str], width: float, unsigned: bool = False) -> DataFrame:
    """Each left row with the row of `table` whose key is the greatest not above the value; of equal keys the row with the greatest `take`.

    Whole numbers are compared as they are, as unsigned ones if asked for; others as
    doubles.  A step is entered in its own cell of `width`, and a cell with values has
    the last step before it too; a value meets the one step that holds it by an
    equi-join of cells, so adaptive execution can split a value that very many rows
    have.  Each row is shuffled once, however far apart the steps are.  Values below all
    steps, nulls and NaN take nothing.
    """
    whole = _whole((left, value), (table, key))
    if whole:
        at, least, most = (lambda c: S.sort_key(F.col(c).cast("long")) if unsigned else F.col(c).cast("long")), -(1 << 63), (1 << 63) - 1
    else:
        at, least, most = (lambda c: F.col(c).cast("double")), -1e200, 1e200
    cells, kind = Cells(width, whole), "long" if whole else "double"
    held = F.struct(*[F.col(c).alias(f"_f{i}") for i, c in enumerate(take)])
    ground = left.sparkSession.createDataFrame([(least,)], f"_on {kind}")
    steps = table.select(at(key).alias("_on"), held.alias("_step")).where("_on is not null").unionByName(ground, allowMissingColumns=True)
    steps = with_following(steps.groupBy("_on").agg(F.max("_step").alias("_step")), "_on", "_to")
    cell = lambda c: (cells.cell(F.col(c), F.lit(0)) if whole else F.floor(F.least(F.greatest(F.col(c) / cells.width, F.lit(-4e18)), F.lit(4e18))).cast("long")).alias("_cell")
    entered = written(steps.select(cell("_on"), F.struct("_on", "_to", "_step").alias("_s")))
    asked = left.withColumn("_v", at(value) if whole else F.least(F.greatest(F.nanvl(at(value), F.lit(None).cast("double")), F.lit(least)), F.lit(most)))
    asked = asked.withColumn("_v", F.when(F.col(value).isNotNull() & (F.lit(whole) | ~F.isnan(at(value))), F.col("_v")))
    points = asked.where("_v is not null").select("*", cell("_v"))
    # of each cell with values, the last step that begins in a cell before it
    ends = entered.groupBy("_cell").agg(F.max("_s").alias("_s"), F.lit(False).alias("_asked")).unionByName(points.select("_cell", F.lit(None).cast(entered.schema["_s"].dataType).alias("_s"), F.lit(True).alias("_asked")).distinct())
    ends = running(ends.groupBy("_cell").agg(F.max("_s").alias("_s"), F.max("_asked").alias("_asked")), [], ["_cell"], _before=("last", F.col("_s"), False))
    spots = written(entered.unionByName(ends.where("_asked and _before is not null").select("_cell", F.col("_before").alias("_s"))).select(F.col("_cell").alias("_spot"), "_s.*"))
    met = points.join(to_join(spots), (F.col("_cell") == F.col("_spot")) & (F.col("_v") >= F.col("_on")) & (F.col("_to").isNull() | (F.col("_v") < F.col("_to"))))
    out = met.select(*left.columns, "_step").unionByName(asked.where("_v is null").select(*left.columns), allowMissingColumns=True)
    return out.select(*left.columns, *[F.col(f"_step._f{i}").alias(c) for i, c in enumerate(take)])


def _nodes(start: Column, end: Column) -> Column:
    """The canonical nodes of [start, end] in a tree over all 64-bit numbers with FAN children a node: at most 30 of each of the 16 levels, and each number of the interval in just one."""

    def whole_cells(level: int) -> tuple[Column, Column]:
        """The cells of a level that lie in the interval: from, to (not included)."""
        bits = FAN_BITS * level
        if not bits:  # the cell after the greatest number has no number itself
            return start, end
        mask = F.lit((1 << bits) - 1)
        return F.shiftright(start, bits) + (start.bitwiseAND(mask) != 0).cast("long"), F.shiftright(end, bits) + (end.bitwiseAND(mask) == mask).cast("long") - 1

    parts = []
    for level in range(FAN):
        low, high = whole_cells(level)  # both included
        span = lambda a, b, level=level: F.when(a <= b, F.transform(F.sequence(a, b), lambda c: F.struct(F.lit(level).alias("_level"), c.alias("_cell"))))
        if level == FAN - 1:
            parts.append(span(low, high))
            continue
        above, last = whole_cells(level + 1)
        some = above <= last
        # where a parent lies in the interval, only what is beside the parents
        left, right = F.shiftleft(above, FAN_BITS) - 1, F.shiftleft(last, FAN_BITS) + FAN
        parts.append(F.when(some & (F.shiftleft(above, FAN_BITS) > low), span(low, left)))
        parts.append(F.when(some & (F.shiftleft(last, FAN_BITS) + (FAN - 1) < high), span(right, high)))
        parts.append(F.when(~some, span(low, high)))
    return F.flatten(F.filter(F.array(*parts), lambda x: x.isNotNull()))


def first_covering(points: DataFrame, intervals: DataFrame, value: str, start: str, end: str, ordinal: str, take: list[str], unsigned: bool = False) -> DataFrame:
    """Each point with the columns `take` of the interval of least ordinal that holds it (ends included), null where none does.

    An interval is cut into canonical nodes of a tree over the numbers, and a node
    keeps the least ordinal of all intervals cut there.  A value looks in its node
    at each level that occurs: rows grow with values times levels, never with the
    pairs of points and intervals.  Whole numbers only.  Of equal ordinals the least
    `take` counts; null ends, and ends before their starts, hold nothing.
    """
    at = lambda c: S.sort_key(F.col(c).cast("long")) if unsigned else F.col(c).cast("long")
    held = F.struct(F.col(ordinal).alias("_ordinal"), *[F.col(c).alias(f"_f{i}") for i, c in enumerate(take)])
    sound = intervals.select(at(start).alias("_s"), at(end).alias("_e"), held.alias("_best")).where("_s <= _e")
    nodes = sound.select(F.explode(_nodes(F.col("_s"), F.col("_e"))).alias("_spot"), "_best").groupBy("_spot").agg(F.min("_best").alias("_best"))
    nodes = written(nodes)
    levels = sorted(r[0] for r in nodes.select("_spot._level").distinct().collect())
    looks = F.array(*[F.struct(F.lit(x).alias("_level"), F.shiftright("_v", FAN_BITS * x).alias("_cell")) for x in levels or [0]])
    values = points.select(at(value).alias("_v")).where("_v is not null").distinct().withColumn("_spot", F.explode(looks))
    best = values.join(to_join(nodes), "_spot").groupBy("_v").agg(F.min("_best").alias("_best"))
    return points.withColumn("_v", at(value)).join(best, "_v", "left").select(*points.columns, *[F.col(f"_best._f{i}").alias(c) for i, c in enumerate(take)])


def points_in_intervals(points: DataFrame, intervals: DataFrame, value: str, start: str, end: str, width: int) -> DataFrame:
    """Pairs with start <= value <= end.

    An interval is entered in at most 17 cells, of `width` or as much wider as it
    needs; a point looks in its cell at each level that occurs.  Intervals whose
    end lies before their start, and nulls, meet nothing.
    """
    sound = intervals.where(F.col(start) <= F.col(end))
    cells = Cells(width, _whole((points, value), (intervals, start), (intervals, end)))
    levels = cells.levels(sound, start, end)
    i = sound.withColumn("_spot", F.explode(cells.spots(F.col(start), F.col(end), cells.level(F.col(start), F.col(end)))))
    p = points.withColumn("_spot", F.explode(cells.looks(F.col(value), levels)))
    return p.join(i, (p["_spot"] == i["_spot"]) & (p[value] >= i[start]) & (p[value] <= i[end])).drop(p["_spot"]).drop(i["_spot"])


def overlapping(left: DataFrame, right: DataFrame, l_start: str, l_end: str, r_start: str, r_end: str, width: int) -> DataFrame:
    """Pairs of intervals that share a point, each once: at the wider one's level, in the first cell where both are."""
    left, right = left.where(F.col(l_start) <= F.col(l_end)), right.where(F.col(r_start) <= F.col(r_end))
    cells = Cells(width, _whole((left, l_start), (left, l_end), (right, r_start), (right, r_end)))
    levels = sorted({*cells.levels(left, l_start, l_end), *cells.levels(right, r_start, r_end)}) or [0]

    def entered(df: DataFrame, start: str, end: str, n: int) -> DataFrame:
        """In every cell that they meet, at their own level and the wider ones of `levels`."""
        own = cells.level(F.col(start), F.col(end))
        at = F.filter(F.array(*map(F.lit, levels)), lambda x: x >= own)
        spots = F.flatten(F.transform(at, lambda x: cells.spots(F.col(start), F.col(end), x)))
        return df.withColumn("_at", F.explode(spots)).withColumn(f"_l{n}", F.col("_at._level")).withColumn(f"_c{n}", F.col("_at._cell")).drop("_at")

    wider = F.greatest(cells.level(F.col(l_start), F.col(l_end)), cells.level(F.col(r_start), F.col(r_end)))
    first = F.greatest(cells.cell(F.col(l_start), F.col("_l1")), cells.cell(F.col(r_start), F.col("_l1")))
    on = (F.col("_l1") == F.col("_l2")) & (F.col("_c1") == F.col("_c2")) & (F.col("_l1") == wider) & (F.col("_c1") == first) & (F.col(l_start) <= F.col(r_end)) & (F.col(r_start) <= F.col(l_end))
    return entered(left, l_start, l_end, 1).join(entered(right, r_start, r_end, 2), on).drop("_l1", "_l2", "_c1", "_c2")


def first_match(pairs: DataFrame, key: list[str], order: list[str], take: list[str]) -> DataFrame:
    """Of the pairs of each key, the first in order."""
    best = F.min_by(F.struct(*take), F.struct(*order)).alias("_best")
    return pairs.groupBy(*key).agg(best).select(*key, *[F.col(f"_best.{c}").alias(c) for c in take])


def two_lookups(left: DataFrame, first: DataFrame, first_on: list[str], second: DataFrame, second_on: list[str], take: str) -> DataFrame:
    """`take` by the first table's keys, else by the second's."""
    a = first.select(*first_on, F.col(take).alias("_a"))
    b = second.select(*second_on, F.col(take).alias("_b"))
    return left.join(a, first_on, "left").join(b, second_on, "left").withColumn(take, F.coalesce("_a", "_b")).drop("_a", "_b")


def zip_compare(left: DataFrame, right: DataFrame, by: list[str], l_order: list[str], r_order: list[str], columns: list[str]) -> DataFrame:
    """Rows of equal place in two ordered streams; `differs` lists the columns that aren't equal."""
    l = running(left, by, l_order, place=("sum", F.lit(1)))  # noqa: E741
    r = running(right, by, r_order, place=("sum", F.lit(1))).select(*by, *[F.col(c).alias(f"other_{c}") for c in columns], "place")
    differs = F.filter(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"other_{c}")), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    return l.join(r, [*by, "place"], "full_outer").withColumn("differs", differs)


def nearest_in_time(df: DataFrame, when: float, address: int, spread: float, time: str, start: str, end: str, key: str) -> DataFrame:
    """The row whose interval holds the address and whose time is nearest, within the spread."""
    near = df.where(F.abs(F.col(time) - when) <= spread).where((F.col(start) <= address) & (F.col(end) >= address))
    return near.orderBy(F.abs(F.col(time) - when), key).limit(1)


def compatible_register(values: DataFrame, snapshot: DataFrame, key: list[str]) -> DataFrame:
    """(key..., reg): the first register of a snapshot (reg, base, length, perms, otype, valid, sealed) that holds just that capability."""
    like = ["base", "length", "perms", "otype", "valid", "sealed"]
    return values.join(snapshot.select(*like, "reg"), like, "left").groupBy(*key).agg(F.min("reg").alias("reg"))
