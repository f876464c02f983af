"""Checks of pointer bounds against symbols, object files and debug information."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import intervals, lookup
from .provenance import _follow as followed
from .scan import running
from .storage import written

LARGE = 4096
CHECKS = ("function", "notype", "exact", "too_short", "too_long", "padded", "misaligned", "outside", "unknown")


def in_object_file(base: Column, top: Column, file_base: Column, tops: Column) -> Column:
    """The base is the file's, and some top of the file isn't exceeded."""
    return (base == file_base) & F.exists(tops, lambda t: top <= t)


def length_verdict(base: Column, length: Column, size: Column) -> Column:
    """Small objects have exactly their size; large ones may be rounded out to their alignment."""
    mask = S.low_mask(S.low_zeros(size))
    aligned = (base.bitwiseAND(mask) == 0) & ((base + length).bitwiseAND(mask) == 0)
    small = F.when(length == size, "exact").when(length < size, "too_short").otherwise("too_long")
    large = F.when(~aligned, "misaligned").when(length < size, "too_short").when(length - size <= mask, F.when(length == size, "exact").otherwise("padded")).otherwise("too_long")
    return F.when(size < LARGE, small).otherwise(large)


def bound_verdict(pointers: DataFrame) -> DataFrame:
    """Adds verdict.  pointers: base, length, and of the symbol found size and type, of the file found file_base and tops."""
    b, n = F.col("base"), F.col("length")
    inside = F.when(in_object_file(b, b + n, F.col("file_base"), F.col("tops")), "function").otherwise("outside")
    verdict = F.when(F.col("type") == "FUNC", inside).when(F.col("type") == "NOTYPE", "notype").when(F.col("type") == "OBJECT", length_verdict(b, n, F.col("size"))).otherwise("unknown")
    return pointers.withColumn("verdict", F.coalesce(verdict, F.lit("unknown")))


def counted(df: DataFrame, key: str, names: tuple[str, ...] = CHECKS, only: Column | None = None) -> DataFrame:
    """(key, n) for all names, zeros too."""
    rows = df if only is None else df.where(only)
    keys = df.sparkSession.createDataFrame([(n,) for n in names], f"{key} string")
    return keys.join(rows.groupBy(key).agg(F.count("*").alias("n")), key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def in_some_range(points: DataFrame, ranges: DataFrame, value: str, name: str) -> DataFrame:
    """`points` with the column `name`: whether the address is in one of the ranges of addresses (start, end; ends included).

    The ranges are united first, so that each value meets the one that begins last
    before it.  Addresses are unsigned; a range whose end lies before its start holds none.
    """
    sorted_ = ranges.select(S.sort_key(F.col("start").cast("long")).alias("_s"), S.sort_key(F.col("end").cast("long")).alias("_e")).where("_s <= _e")
    united = intervals.union(sorted_, "_s", "_e")
    found = lookup.floor_lookup(points.withColumn("_v", S.sort_key(F.col(value).cast("long"))), united, "_v", "_s", ["_e"], float(1 << 12))
    return found.withColumn(name, F.coalesce(F.col("_v") <= F.col("_e"), F.lit(False))).drop("_v", "_e")


def object_files(points: DataFrame, files: DataFrame, address: str) -> DataFrame:
    """Each row with the first object file whose range holds the address.  files: ordinal, objfile, file_base, tops; a row per file.  Addresses are unsigned."""
    spans = files.withColumn("_last", F.array_max("tops") - 1)
    return lookup.first_covering(points, spans, address, "file_base", "_last", "ordinal", ["objfile", "file_base", "tops"], unsigned=True)


def symbols_of(pointers: DataFrame, symbols: DataFrame, relocs: DataFrame) -> DataFrame:
    """size and type by name and address, else by the relocation at the address."""
    s = symbols.groupBy("objfile", "name", "addr").agg(F.max(F.struct("size", "type")).alias("_s"))
    r = relocs.groupBy(F.col("target").alias("addr")).agg(F.max("length").alias("_r"))
    joined = pointers.join(s, ["objfile", "name", "addr"], "left").join(r, "addr", "left")
    return joined.withColumn("size", F.coalesce("_s.size", "_r")).withColumn("type", F.coalesce("_s.type", F.when(F.col("_r").isNotNull(), "OBJECT"))).drop("_s", "_r")


def size_conflicts(symbols: DataFrame) -> DataFrame:
    """(objfile, addr, sizes, least, most): addresses whose symbols have different sizes."""
    return symbols.groupBy("objfile", "addr").agg(F.count_distinct("size").alias("sizes"), F.min("size").alias("least"), F.max("size").alias("most")).where("sizes > 1")


def pending(uses: DataFrame, by: list[str], order: str) -> DataFrame:
    """Pointers that must be narrowed before they are used.

    uses: by..., order, reg, kind: `derive` opens a session of the register in a
    function activation, `bound` ends it well, `use` is a violation if it comes
    first, and `overwrite` and `return` end it.  Returns each session and its outcome.
    """
    own = W.partitionBy(*by, "reg").orderBy(order)
    following = uses.withColumn("next_kind", F.lead("kind").over(own)).withColumn("next_at", F.lead(order).over(own)).where("kind = 'derive'")
    outcome = F.when(F.col("next_kind") == "bound", "bounded").when(F.col("next_kind") == "use", "used_before_bound").when(F.col("next_kind") == "derive", "replaced").when(F.col("next_kind").isNotNull(), "dropped").otherwise("open")
    return following.withColumn("outcome", outcome).select(*by, "reg", order, "next_at", "outcome")


#: Registers that the pending sets know: the stack's capability, the frame's, and that of arguments on the stack.
STACK, FRAME, ARGUMENTS = 11, 24, 13
OUTCOMES = ("bounded", "wrong_bound", "matched", "used", "overwritten", "returned", "open")
#: What bounds may be of a length that the verdict calls right.
RIGHT = ("exact", "padded")


def _values(steps: DataFrame, by: list[str], width: float) -> tuple[DataFrame, DataFrame]:
    """(touches, holders): rows (by..., at, value) that read a register, with the value it held, and (value, by..., reg, at, until) of the registers that hold it.

    A value is named by the row that made it; moves are copies, followed by doubling.
    """
    name = lambda: F.struct(*by, "at")
    writes = steps.where("dst is not null").select(*by, F.col("dst").alias("reg"), "at", name().alias("_value"))
    read = F.array_distinct(F.filter(F.concat(F.coalesce("reads", F.array().cast("array<int>")), F.array("src")), lambda x: x.isNotNull()))
    reads = steps.select(*by, "at", F.explode(read).alias("reg"), (F.col("act") == "move").alias("_move"))
    seen = written(lookup.as_of_chunked(reads, writes, [*by, "reg"], "at", ["_value"], width, strict=True).where("_value is not null"))
    copies = seen.where("_move").select(name().alias("vid"), F.col("_value").alias("to"))
    own = writes.join(copies, writes["_value"] == copies["vid"], "left").select(F.col("_value").alias("vid"), F.coalesce("to", "_value").alias("to"))
    values = written(followed(own).withColumnRenamed("to", "value"))
    touches = seen.where("not _move").join(values, seen["_value"] == values["vid"]).select(*by, "at", "value")
    spans = lookup.with_next(writes, [*by, "reg"], "at", {"until": "at"}, width)
    holders = spans.join(values, spans["_value"] == values["vid"]).select("value", *by, "reg", "at", "until")
    return touches, holders


def _sessions(opened: DataFrame, steps: DataFrame, touches: DataFrame, holders: DataFrame, by: list[str]) -> DataFrame:
    """The opened sessions with what ended them."""
    first = touches.join(opened.select("value", F.col("at").alias("_opened")).distinct(), "value").where("at > _opened").groupBy("value").agg(F.min(F.struct("at", *by)).alias("_t"))
    met = first.select("value", "_t.*").join(steps.select(*by, "at", "act", "dst", "src", "amount", "base", "length"), [*by, "at"])
    met = met.select("value", F.struct("at", "act", "dst", "src", "amount", "base", "length").alias("t"))
    gone = holders.groupBy("value").agg(F.max("until").alias("_gone"), F.max(F.col("until").isNull()).alias("_held"))
    joined = opened.join(met, "value", "left").join(gone, "value", "left")
    narrowed = (F.col("t.act") == "bounds") & (F.col("t.dst") == F.col("t.src"))
    right = F.when(F.col("set") == "stack", length_verdict(F.col("t.base"), F.col("t.length"), F.col("size")).isin(*RIGHT)).otherwise(F.col("t.amount") == F.col("size"))
    touched = F.when(F.col("set") == "andperm", F.when((F.col("t.act") == "perms") & (F.col("t.dst") == ARGUMENTS), "matched").otherwise("used"))
    touched = touched.otherwise(F.when(narrowed, F.when(right, "bounded").otherwise("wrong_bound")).otherwise("used"))
    back_at = F.col("back")
    lost = F.when(~F.coalesce("_held", F.lit(True)), F.col("_gone"))
    ends = F.when(F.col("t.at").isNotNull() & (back_at.isNull() | (F.col("t.at") < back_at)), F.struct(touched.alias("outcome"), F.col("t.at").alias("ended")))
    ends = ends.when(lost.isNotNull() & (back_at.isNull() | (lost < back_at)), F.struct(F.lit("overwritten").alias("outcome"), lost.alias("ended")))
    ends = ends.when(back_at.isNotNull(), F.struct(F.lit("returned").alias("outcome"), back_at.alias("ended"))).otherwise(F.struct(F.lit("open").alias("outcome"), F.lit(None).cast("long").alias("ended")))
    return joined.withColumn("_e", ends).select(*by, "at", "set", "variable", "member", "reg", "size", "_e.outcome", "_e.ended", "value", "members")


def pending_sets(steps: DataFrame, locations: DataFrame, by: list[str], width: float = 1_000_000.0) -> DataFrame:
    """(by..., at, set, variable, member, reg, size, outcome, ended): pointers that must be narrowed before they are used.

    steps: by... (a function's activation), at (the order), pc, act, dst, src,
    amount, base, length (of dst afterwards), reads (other registers that are
    read).  act: `offset`, `bounds`, `perms`, `move`, `return` or another.
    locations: variable, lowpc, highpc, offset, size, members (array of name,
    offset, size; null unless the variable is an aggregate), where the pc has to be
    in [lowpc, highpc - 4).

    Three sets, as sessions of values: they follow a value through moves to other
    registers, and don't follow a register that gets another value.

    - stack: made by an offset from the stack or frame register to a variable's
      place; the bounds set on it in place end it, right or wrong.
    - subobject: made by an offset to a member's place from a pointer to an aggregate
      variable whose stack session ended right.
    - andperm: made by bounds set from the stack register on another; ended when
      permissions are dropped from it into the argument register.

    The first read of the value that isn't a move decides; before any, a session
    ends when all its registers were overwritten, or the activation returns.
    """
    steps = running(steps.withColumn("at", F.col("at").cast("long")), by, ["at"], back=("next", F.when(F.col("act") == "return", F.col("at"))))
    touches, holders = _values(steps, by, width)
    touches, holders = written(touches), written(holders)
    value = F.struct(*by, "at").alias("value")
    offsets = steps.where("act = 'offset'")
    none = F.lit(None).cast("string")
    made = offsets.where(F.col("src").isin(STACK, FRAME) & ~F.col("dst").isin(STACK, FRAME))
    scopes = locations.withColumn("_last", F.col("highpc") - 5).withColumnRenamed("offset", "_offset")
    found = lookup.points_in_intervals(made, scopes, "pc", "lowpc", "_last", 64).where(F.col("amount") == F.col("_offset"))
    # of several variables at one place the first by name
    pick = found.groupBy(*by, "at", "back", F.col("dst").alias("reg")).agg(F.min(F.struct("variable", "size")).alias("_v"), F.min_by("members", F.struct("variable", "size")).alias("members"))
    stack = pick.select(*by, "at", F.lit("stack").alias("set"), "_v.variable", none.alias("member"), "reg", "_v.size", value, "members", "back")
    argued = steps.where((F.col("act") == "bounds") & (F.col("src") == STACK) & (F.col("dst") != F.col("src")))
    argued = argued.select(*by, "at", F.lit("andperm").alias("set"), none.alias("variable"), none.alias("member"), F.col("dst").alias("reg"), F.lit(None).cast("long").alias("size"), value, F.lit(None).cast(locations.schema["members"].dataType).alias("members"), "back")
    ended = written(_sessions(stack.unionByName(argued), steps, touches, holders, by))
    whole = ended.where("set = 'stack' and outcome = 'bounded' and members is not null").select(F.struct(*by, F.col("ended").alias("at")).alias("value"), "variable", "members")
    # offsets from a pointer to an aggregate
    inner = offsets.join(touches, [*by, "at"]).join(whole, "value").select(*by, "at", "back", F.col("dst").alias("reg"), "amount", "variable", F.explode("members").alias("_m"))
    inner = inner.where(F.col("amount") == F.col("_m.offset")).groupBy(*by, "at", "back", "reg", "variable").agg(F.min(F.struct("_m.name", "_m.size")).alias("_m"))
    parts = inner.select(*by, "at", F.lit("subobject").alias("set"), "variable", F.col("_m.name").alias("member"), "reg", F.col("_m.size").alias("size"), value, F.lit(None).cast(locations.schema["members"].dataType).alias("members"), "back")
    return ended.unionByName(_sessions(parts, steps, touches, holders, by)).drop("value", "members")


def call_verdicts(calls: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(idx, side, address, verdict): whether the link and the target of each call have the bounds that they should have.

    calls: idx, link, target (structs of base, offset, length).  files: as for
    `object_files`.  symbols: addr, size, type.  A link has to be bounded as its
    object file: `correct` or `incorrect`, `unknown` outside all files.  A target in
    user space has to be bounded as the symbol at its address says (`correct` for a
    function within its file, or a length that is right), `unknown` without one.
    """
    side = lambda n: F.struct(F.lit(n).alias("side"), F.col(f"{n}.base").alias("base"), F.col(f"{n}.length").alias("length"), S.cursor(F.col(f"{n}.base"), F.col(f"{n}.offset")).alias("address"))
    rows = calls.select("idx", F.explode(F.array(side("link"), side("target"))).alias("c")).select("idx", "c.*").where("side = 'link' or address >= 0")
    placed = object_files(rows, files, "address")
    s = symbols.groupBy(F.col("addr").alias("address")).agg(F.max(F.struct("size", "type")).alias("_s"))
    judged = bound_verdict(placed.join(s, "address", "left").withColumn("size", F.col("_s.size")).withColumn("type", F.col("_s.type")))
    link = F.when(F.col("objfile").isNull(), "unknown").when(in_object_file(F.col("base"), F.col("base") + F.col("length"), F.col("file_base"), F.col("tops")), "correct").otherwise("incorrect")
    target = F.when(F.col("_s").isNull(), "unknown").when(F.col("verdict").isin("function", *RIGHT), "correct").otherwise("incorrect")
    return judged.select("idx", "side", "address", F.when(F.col("side") == "link", link).otherwise(target).alias("verdict"))


def live_variable_lengths(pointers: DataFrame, locations: DataFrame) -> DataFrame:
    """Pointers in the register where a variable lives, with the verdict on its annotated length.  The pc is in [lowpc, highpc - 4)."""
    spans = locations.withColumn("_last", F.col("highpc") - 5)
    met = lookup.points_in_intervals(pointers, spans, "pc", "lowpc", "_last", 64).where(F.col("reg") == F.col("cap_register")).drop("_last")
    return met.withColumn("verdict", length_verdict(F.col("base"), F.col("length"), F.col("expected_length")))


def frequencies(df: DataFrame, address: str) -> DataFrame:
    return df.groupBy(address).agg(F.count("*").alias("n"))


def call_checks(calls: DataFrame) -> DataFrame:
    """The link and the target capability of each call as rows of their own; kernel targets are left out."""
    sides = F.explode(F.array(F.struct(F.lit("link").alias("side"), F.col("link").alias("cap")), F.struct(F.lit("target").alias("side"), F.col("target").alias("cap"))))
    return calls.select("idx", sides.alias("s")).select("idx", "s.side", "s.cap.*").where("base >= 0")


def table_pointer_checks(pointers: DataFrame, tables: DataFrame) -> DataFrame:
    """Whether pointers made from the program counter point into a capability table (ends included): `in_table`."""
    return in_some_range(pointers, tables.select("start", "end"), "cursor", "in_table")


def static_table_check(table: DataFrame, symbols: DataFrame, file_base: Column, tops: Column) -> DataFrame:
    """The entries of a capability table (slot, base, length) with the verdict on the symbol at their slot's address, and its name.

    symbols: objfile, name, addr, size, type.  An address with several symbols is
    checked against the largest.  `counted` sums the verdicts.
    """
    s = symbols.groupBy(F.col("addr").alias("slot")).agg(F.max(F.struct("size", "type", "objfile", "name")).alias("_s"))
    joined = table.join(s, "slot", "left").withColumn("size", F.col("_s.size")).withColumn("type", F.col("_s.type")).withColumn("objfile", F.col("_s.objfile")).withColumn("name", F.col("_s.name")).drop("_s")
    return bound_verdict(joined.withColumn("file_base", file_base).withColumn("tops", tops)).drop("file_base", "tops")


def table_load_check(loads: DataFrame, tables: DataFrame, created: DataFrame, by: list[str], order: str) -> DataFrame:
    """Capability loads from tables: whether they go through a table, its size and the pointer made for it.

    loads: by..., order, reg, cursor (the address of the pointer that is loaded
    through), length (its length), is_kernel.  tables: start, end.  created: by...,
    order, reg, cursor, the pointers made from the program counter.  Adds
    from_table, sound_bound (the length is the table's size; null outside a table)
    and made: matching, different, or missing (user code alone; else null).
    """
    spans = tables.where(S.sort_key(F.col("start")) <= S.sort_key(F.col("end"))).groupBy("start").agg(F.max_by("end", S.sort_key(F.col("end"))).alias("_end"))
    steps = spans.select(F.col("start").alias("_on"), F.col("start").alias("_start"), "_end")
    found = lookup.floor_lookup(loads, steps, "cursor", "_on", ["_start", "_end"], float(1 << 12), unsigned=True)
    seen = lookup.as_of(found, created.select(*by, order, "reg", F.col("cursor").alias("_made")), [*by, "reg"], order, ["_made"], strict=True)
    inside = F.coalesce(S.sort_key(F.col("cursor").cast("long")) <= S.sort_key(F.col("_end")), F.lit(False))
    made = F.when(F.col("_made").isNull(), F.when(~F.col("is_kernel"), "missing")).when(F.col("_made") == F.col("cursor"), "matching").otherwise("different")
    out = seen.withColumn("from_table", inside).withColumn("sound_bound", F.when(inside, F.col("length") == F.col("_end") - F.col("_start"))).withColumn("made", F.when(inside, made))
    return out.drop("_start", "_end", "_made")


def thread_local_reads(reads: DataFrame) -> DataFrame:
    """(addr, pc, n): where thread-local storage is read through the user's hardware register, and the last place that does it.  reads: idx, pc, hw (its name), base, offset."""
    own = reads.where("hw = 'chwr_userlocal'").withColumn("addr", S.cursor(F.col("base"), F.col("offset")))
    return own.groupBy("addr").agg(F.max_by("pc", "idx").alias("pc"), F.count("*").alias("n"))
