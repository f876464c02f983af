"""Where every pointer of a trace came from, without reading the trace in one sequence.

Instructions are first turned to micro-operations on locations (registers `r0`,
`r1`, ... and memory words `m<address>`).  Every write of a location is a version;
what a read sees is the last version before it, an as-of lookup by location in
chunks of the trace.  Versions that copy point to the version that they copy, and
pointers are followed by doubling.  A vertex is a version that makes a pointer.

Micro-operations, in order of `idx` and `sub`:

- root(dst): a pointer from nowhere.  clear(dst): none.
- derive(dst, src): a new pointer whose parent is what src holds.
- copy(dst, src): dst holds what src holds.  If the value is valid and src holds no
  known pointer, src first becomes a root.
- store(addr, src): copies a valid value to memory (an invalid one does nothing).
- load(dst, addr): a valid value is the pointer stored there if base, length,
  permissions and type agree, else the word becomes a root; an invalid one clears both.
- wipe(addr): a plain store over a stored pointer.
- use(src): a dereference; `flags` says which, at `addr`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from .lookup import as_of_chunked, with_next, with_running_sum
from .storage import dropped
from .storage import written as _written

UOP = (
    "idx long, sub int, act string, dst string, src string, addr long, valid boolean, origin string, pc long, is_kernel boolean, "
    "base long, offset long, length long, perms int, otype int, sealed boolean, flags int, time long"
)
_CAP = ("base", "length", "perms", "otype")
#: Versions of one micro-operation follow each other within so many places; so many micro-operations can act at one row (held-back ones at the read of the fault address).
_PLACES, _SUBS = 4, 1 << 16


@dataclass(frozen=True)
class Provenance:
    vertices: DataFrame
    edges: DataFrame
    events: DataFrame
    #: (reg, idx, until, vid): the spans in which registers hold pointers.
    registers: DataFrame | None = None


def _at(idx: Column, sub: Column, place: int = 0) -> Column:
    return idx * (_SUBS * _PLACES) + sub * _PLACES + place


def _word(addr: Column) -> Column:
    return F.concat(F.lit("m"), addr.cast("string"))


def _versions(uops: DataFrame, chunk: float) -> DataFrame:
    """(at, loc, kind, src, cap...): every write of a location; kind root, clear, derive, own, copy or weak.

    `own` keeps what the location holds, or makes a root if that is no pointer;
    `copy` follows such a version, `weak` follows whatever there is.
    """
    u = uops.withColumn("m", _word(F.col("addr")))
    place = lambda n: _at(F.col("idx"), F.col("sub"), n)
    row = lambda n, loc, kind, src: F.struct(place(n).alias("at"), loc.alias("loc"), F.lit(kind).alias("kind"), src.alias("src"))
    none = F.lit(None).cast("string")
    dst, src, m = F.col("dst"), F.col("src"), F.col("m")
    good = F.coalesce("valid", F.lit(False))
    act = F.col("act")
    made = (
        F.when(act == "root", F.array(row(0, dst, "root", none)))
        .when(act == "clear", F.array(row(0, dst, "clear", none)))
        .when(act == "derive", F.array(row(1, dst, "derive", src)))
        .when((act == "copy") & good, F.array(row(0, src, "own", src), row(1, dst, "copy", src)))
        .when(act == "copy", F.array(row(1, dst, "weak", src)))
        .when((act == "store") & good, F.array(row(0, src, "own", src), row(1, m, "copy", src)))
        .when((act == "load") & good, F.array(row(0, m, "fetch", m), row(1, dst, "copy", m)))
        .when(act == "load", F.array(row(0, m, "clear", none), row(1, dst, "clear", none)))
    )
    rest = [c for c in uops.columns if c not in ("act", "dst", "src", "addr", "sub")]
    rows = u.withColumn("_v", F.explode(made)).select("_v.*", *rest)
    # a fetch is `own` if the word's last version holds a like capability, else a root
    words = rows.where("loc like 'm%'")
    fetches = words.where("kind = 'fetch'").select("at", "loc", F.struct(*_CAP).alias("_seen"))
    held = words.select("loc", "at", F.when(F.col("kind") != "clear", F.struct(*_CAP)).alias("_held"))
    held = held.withColumn("_held", F.struct(F.col("_held").alias("cap")))
    like = as_of_chunked(fetches, held, ["loc"], "at", ["_held"], chunk, strict=True).select("at", "loc", F.coalesce(F.col("_held.cap") == F.col("_seen"), F.lit(False)).alias("_like"))
    joined = rows.join(like, ["at", "loc"], "left")
    return joined.withColumn("kind", F.when(F.col("kind") == "fetch", F.when(F.col("_like"), "own").otherwise("root")).otherwise(F.col("kind"))).drop("_like")


def _follow(pointers: DataFrame) -> DataFrame:
    """(vid, to): where chains of `to` end; rounds grow with the logarithm of the longest chain."""
    state = _written(pointers.select("vid", "to"))
    for _ in range(state.count().bit_length() + 1):  # no chain has more versions than there are
        step = state.select(F.col("vid").alias("to"), F.col("to").alias("_next"))
        joined = _written(state.join(step, "to", "left").select("vid", F.coalesce("_next", "to").alias("to"), (F.col("_next").isNotNull() & (F.col("_next") != F.col("to"))).alias("moved")))
        dropped(state)
        state = joined
        if not joined.where("moved").take(1):
            return state.drop("moved")
    raise ValueError("the pointers form a cycle")


def provenance(uops: DataFrame, chunk_rows: int = 1_000_000) -> Provenance:
    """Vertices, derivation edges and events of a trace's micro-operations.

    A vertex's id is the place of the version that made it, so ids don't depend on
    how the trace is divided; those of initial values are negative.
    """
    chunk = float(chunk_rows * _SUBS * _PLACES)
    v = _written(_versions(uops, chunk))
    # no two versions have one place, so the place names the version
    reads = v.where("src is not null").select("at", F.col("loc").alias("_loc"), F.col("src").alias("loc"))
    seen = as_of_chunked(reads, v.select("loc", "at", F.col("at").alias("to"), "kind"), ["loc"], "at", ["to", "kind"], chunk, strict=True)
    seen = _written(seen.select("at", F.col("_loc"), F.col("loc").alias("src"), F.col("to"), F.col("kind").alias("to_kind")))
    own = v.join(seen.select("at", F.col("_loc").alias("loc"), "to", "to_kind"), ["at", "loc"], "left")
    own = _written(own.withColumnRenamed("at", "vid"))
    # weak copies: what they follow first, to tell pointers from none
    weak = own.where("kind = 'weak' and to is not null").select("vid", "to")
    ends = _follow(weak.unionByName(own.where("kind <> 'weak'").join(weak.select(F.col("to").alias("vid")).distinct(), "vid", "left_semi").select("vid", F.col("vid").alias("to")).distinct()))
    kinds = own.groupBy("vid").agg(F.max("kind").alias("kind"))
    real_weak = ends.join(kinds.withColumnRenamed("vid", "to").withColumnRenamed("kind", "_k"), "to").where("_k in ('root', 'derive', 'own', 'copy')").select(F.col("vid").alias("to"), F.lit(True).alias("_real"))
    # versions that follow nothing stay out of the join, where a null would be one key
    known = own.where("to is not null").join(real_weak, "to", "left").unionByName(own.where("to is null").withColumn("_real", F.lit(None).cast("boolean")))
    real = F.col("to_kind").isin("root", "derive", "own", "copy") | F.coalesce("_real", F.lit(False))
    makes = F.col("kind").isin("root", "derive") | ((F.col("kind") == "own") & ~F.coalesce(real, F.lit(False)))
    known = _written(known.withColumn("makes", makes).withColumn("real", F.coalesce(real, F.lit(False))))
    target = F.when(F.col("makes"), F.col("vid")).when(F.col("kind").isin("own", "copy", "weak") & F.col("real"), F.col("to"))
    resolved = _follow(known.withColumn("to", target).where("to is not null").select("vid", "to").distinct()).withColumnRenamed("to", "vertex")
    resolved = _written(resolved)
    made = known.where("makes")
    origin = F.when(F.col("kind") == "derive", F.coalesce("origin", F.lit("DERIVED"))).otherwise("ROOT")
    vertices = made.select("vid", origin.alias("origin"), "pc", "is_kernel", "base", "offset", "length", "perms", "otype", "valid", "sealed", F.col("time").alias("t_alloc"))
    derived = made.where("kind = 'derive'").select("vid", "to", "src")
    parents = derived.join(resolved.select(F.col("vid").alias("to"), F.col("vertex").alias("parent")), "to", "left")
    # a derivation from a register's initial value hangs on that value
    initial = parents.where("to is null").groupBy("src").agg(F.min("vid").alias("_first")).select("src", (-F.col("_first")).alias("_initial"))
    parents = parents.join(initial, "src", "left")
    edges = parents.select(F.coalesce("parent", F.when(F.col("to").isNull(), F.col("_initial"))).alias("src"), F.col("vid").alias("dst"))
    begin = parents.where("to is null").join(made, "vid").groupBy("_initial").agg(F.min("base").alias("base"), F.max(F.col("base") + F.col("length")).alias("_top"), F.bit_or("perms").alias("perms"), F.min("otype").alias("otype"))
    begin = begin.select(F.col("_initial").alias("vid"), F.lit("INITIAL_ROOT").alias("origin"), F.lit(0).cast("long").alias("pc"), F.lit(False).alias("is_kernel"), "base", F.lit(0).cast("long").alias("offset"), (F.col("_top") - F.col("base")).alias("length"), "perms", "otype", F.lit(True).alias("valid"), F.lit(False).alias("sealed"), F.lit(-1).cast("long").alias("t_alloc"))
    events = _events(uops, v, resolved, chunk)
    spans = _written(_spans(known, resolved, v, chunk))
    ends = _ends(spans, events, chunk)
    vertices = vertices.unionByName(begin).join(ends, "vid", "left").withColumn("t_free", F.coalesce("t_free", F.lit(-1)))
    place = lambda c: F.shiftright(c, (_SUBS * _PLACES).bit_length() - 1)
    registers = spans.where("vertex is not null").select(F.substring("loc", 2, 10).cast("int").alias("reg"), place("at").alias("idx"), place("_to").alias("until"), F.col("vertex").alias("vid"))
    return Provenance(vertices, edges, events.select("vid", "time", "addr", "type", "at"), registers)


def _events(uops: DataFrame, v: DataFrame, resolved: DataFrame, chunk: float) -> DataFrame:
    """(vid, time, addr, type, at): dereferences, loads, stores, and stores over stored pointers."""
    usr = F.when(F.coalesce("is_kernel", F.lit(False)), 0).otherwise(S.EVENTS["usr"])
    u = uops.withColumn("_m", _word(F.col("addr")))
    act, good = F.col("act"), F.coalesce("valid", F.lit(False))
    at = lambda n: _at(F.col("idx"), F.col("sub"), n)
    row = lambda n, loc, flag: F.struct(at(n).alias("at"), loc.alias("loc"), flag.cast("int").alias("type"))
    seen = (
        F.when(act == "use", F.array(row(0, F.col("src"), F.col("flags"))))
        .when((act == "load") & good, F.array(row(3, F.col("_m"), F.lit(S.EVENTS["load"]))))
        .when((act == "store") & good, F.array(row(1, F.col("_m"), F.lit(S.EVENTS["delete"])), row(3, F.col("_m"), F.lit(S.EVENTS["store"]))))
        .when(act == "wipe", F.array(row(1, F.col("_m"), F.lit(S.EVENTS["delete"]))))
    )
    asked = u.withColumn("_e", F.explode(seen)).select("_e.at", "_e.loc", (F.col("_e.type").bitwiseOR(usr)).alias("type"), "time", "addr")
    found = as_of_chunked(asked, v.select("loc", "at", F.col("at").alias("to")), ["loc"], "at", ["to"], chunk, strict=True)
    return found.join(resolved.select(F.col("vid").alias("to"), F.col("vertex").alias("vid")), "to").select("vid", "time", "addr", "type", "at")


def _spans(known: DataFrame, resolved: DataFrame, v: DataFrame, chunk: float) -> DataFrame:
    """(loc, at, vertex, _to, _next, _when): what each version of a register holds, and the version after it."""
    held = known.where("loc like 'r%'").join(resolved, "vid").select("loc", F.col("vid").alias("at"), "vertex")
    every = v.where("loc like 'r%'").select("loc", "at", "time").join(held, ["loc", "at"], "left")
    return with_next(every, ["loc"], "at", {"_next": "vertex", "_to": "at", "_when": "time"}, chunk)


def _ends(spans: DataFrame, events: DataFrame, chunk: float) -> DataFrame:
    """(vid, t_free): the last moment at which a version of the vertex went and none was left."""
    spans = spans.where("vertex is not null")
    moves = spans.select(F.explode(F.array(
        F.struct(F.col("vertex").alias("vid"), F.col("at"), F.lit(1).alias("step"), F.lit(None).cast("long").alias("free")),
        F.struct(F.col("vertex").alias("vid"), F.col("_to").alias("at"), F.lit(-1).alias("step"), F.when(~F.col("_next").eqNullSafe(F.col("vertex")) & F.col("_next").isNotNull(), F.col("_when")).alias("free")),
    )).alias("p")).select("p.*").where("at is not null")
    stored = S.has_any(F.col("type"), S.EVENTS["store"])
    memory = events.where(stored | S.has_any(F.col("type"), S.EVENTS["delete"]))
    order = W.partitionBy("vid", "addr").orderBy("at")
    was = F.lag(stored.cast("int")).over(order)
    step = F.when(stored, F.when(F.coalesce(was, F.lit(0)) == 1, 0).otherwise(1)).otherwise(F.when(F.coalesce(was, F.lit(0)) == 1, -1).otherwise(0))
    memory = memory.select("vid", "at", step.alias("step"), F.when(~stored, F.col("time")).alias("free"))
    points = moves.unionByName(memory).groupBy("vid", "at").agg(F.sum("step").alias("step"), F.max("free").alias("free"))
    live = with_running_sum(points, ["vid"], "at", "step", "live", chunk)
    return live.where("live = 0 and free is not null").groupBy("vid").agg(F.max("free").alias("t_free"))
