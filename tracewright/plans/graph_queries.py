"""Queries of the graph operators on the driver's tables.

Orders are pointers derived from the customer's order before, line items are
their events, and customers are the calls that return them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import provenance, verify

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_CALL = 1_000_000_000

_VIEWS = f"""v as (select o_orderkey as vid, case o_orderpriority when '1-URGENT' then 'ROOT' when '2-HIGH' then 'FROMPTR' when '3-MEDIUM' then 'SETBOUNDS' when '4-NOT SPECIFIED' then 'ANDPERM' else 'INITIAL_ROOT' end as origin,
  o_custkey * 4 as pc, o_orderstatus = 'F' as is_kernel, cast(floor(o_totalprice) as bigint) as base, o_custkey % 64 as length, cast(o_orderkey % 2048 as integer) as perms, o_orderstatus <> 'P' as valid, o_orderkey as t_alloc,
  case when o_orderkey % 3 = 0 then -1 else o_orderkey + 100 end as t_free from orders),
e as (select l_orderkey as vid, cast(l_linenumber as bigint) as time, cast(floor(l_extendedprice) as bigint) as addr, case l_returnflag when 'R' then 132 when 'A' then 2 else 40 end as type from lineitem),
d as (select lag(o_orderkey) over (partition by o_custkey order by o_orderkey) as src, o_orderkey as dst from orders),
r as (select o_orderkey as src, {_CALL} + o_custkey as dst, o_orderkey % 5 as reg from orders),
c as (select {_CALL} + c_custkey as vid, cast(c_nationkey as bigint) as address, case when c_mktsegment = 'BUILDING' then 'malloc' else c_mktsegment end as symbol from customer)"""


def _add(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"with recursive {_VIEWS}, {sql[5:]}" if sql.startswith("with ") else f"with {_VIEWS} {sql}"
        return f

    return keep


def graph_of(spark: SparkSession, sf: str) -> G.Graph:
    t = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    o, l, c = t("orders"), t("lineitem"), t("customer")  # noqa: E741
    p = F.col("o_orderpriority")
    origin = F.when(p == "1-URGENT", "ROOT").when(p == "2-HIGH", "FROMPTR").when(p == "3-MEDIUM", "SETBOUNDS").when(p == "4-NOT SPECIFIED", "ANDPERM").otherwise("INITIAL_ROOT")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    vertices = o.select(
        key.alias("vid"), origin.alias("origin"), (cust * 4).alias("pc"), (F.col("o_orderstatus") == "F").alias("is_kernel"), F.floor("o_totalprice").cast("bigint").alias("base"), F.lit(0).cast("bigint").alias("offset"), (cust % 64).alias("length"),
        (key % 2048).cast("int").alias("perms"), F.lit(0).alias("otype"), (F.col("o_orderstatus") != "P").alias("valid"), F.lit(False).alias("sealed"), key.alias("t_alloc"), F.when(key % 3 == 0, -1).otherwise(key + 100).alias("t_free"),
    )
    kind = F.when(F.col("l_returnflag") == "R", 132).when(F.col("l_returnflag") == "A", 2).otherwise(40)
    events = l.select(F.col("l_orderkey").alias("vid"), F.col("l_linenumber").cast("bigint").alias("time"), F.floor("l_extendedprice").cast("bigint").alias("addr"), kind.alias("type"))
    calls = c.select((F.col("c_custkey") + _CALL).alias("vid"), F.col("c_nationkey").cast("bigint").alias("address"), F.when(F.col("c_mktsegment") == "BUILDING", "malloc").otherwise(F.col("c_mktsegment")).alias("symbol"), F.lit(None).cast("string").alias("symbol_file"), F.lit(None).cast("bigint").alias("t_return"), F.lit(None).cast("bigint").alias("addr_return"), F.lit(0).cast("bigint").alias("frame_base"), F.lit(0).cast("bigint").alias("frame_size"))
    none = F.lit(None).cast("bigint")
    derived = o.select(key.alias("eid"), F.lag("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderkey")).alias("src"), key.alias("dst"), F.lit(0).alias("op"), none.alias("time"), none.alias("addr"), F.lit(None).cast("array<int>").alias("regs")).where("src is not null")
    returned = o.select(key.alias("eid"), key.alias("src"), (cust + _CALL).alias("dst"), F.lit(G.RETURN).alias("op"), key.alias("time"), none.alias("addr"), F.array((key % 5).cast("int")).alias("regs"))
    return G.Graph(vertices, events, calls, derived.unionByName(returned), "orders")


@_add("select vid, origin from v where not ((length = 0 and base = 0) or not valid) and not (pc <> 0 and is_kernel) and origin not in ('ANDPERM', 'ROOT', 'INITIAL_ROOT') and not (base >= 1000 and base + length <= 50000)")
def graph_masks(spark, sf):
    g = graph_of(spark, sf).transform(G.without_null, G.without_kernel, G.without_andperm, G.without_roots, G.without_stack(1000, 50000))
    return g.vertices.select("vid", "origin")


@_add("select vid, origin from v where vid in (select vid from e where time between 3 and 5 and type & 28 <> 0) or t_alloc between 100 and 900")
def graph_time_slice(spark, sf):
    return graph_of(spark, sf).transform(G.time_slice(100, 900, deref=False)).vertices.select("vid", "origin").unionByName(graph_of(spark, sf).transform(G.time_slice(3, 5, creation=False, deref=True)).vertices.select("vid", "origin")).distinct()


@_add("with s as (select r.src as vid from r join c on c.vid = r.dst where c.symbol = 'malloc' and r.reg = 3), t as (select vid from s union select d.dst from t join d on d.src = t.vid) select v.vid, v.vid in (select vid from t) as malloc from v")
def graph_malloc(spark, sf):
    return G.malloc_pointers(graph_of(spark, sf)).vertices.select("vid", F.col("annotated_malloc").alias("malloc"))


@_add("""select cast(count(*) filter (type & 4 <> 0) as bigint) as deref_loads, cast(count(*) filter (type & 8 <> 0) as bigint) as deref_stores,
 (select cast(sum(n) as bigint) from (select count(distinct addr) as n from e where type & 2 <> 0 group by vid)) as stored_addresses,
 (select count(distinct e.vid) from e join v using (vid) where type & 4 <> 0 and addr between base and base + length) as argument_readers,
 (select count(*) from v where origin = 'SETBOUNDS') as set_bounds, (select count(*) from v where origin = 'SETBOUNDS' and base >= 1000 and base + length <= 50000) as stack_bounds,
 (select count(*) from r join c on c.vid = r.dst where c.symbol = 'malloc' and r.reg = 3) as mallocs, cast(0 as bigint) as mmaps from e""")
def graph_statistics(spark, sf):
    return G.statistics(graph_of(spark, sf), (1000, 50000))


@_add("""select a.vid, a.origin, a.t_alloc, a.t_free from (
 select v.vid, case when p.vid is not null and v.origin = 'SETBOUNDS' then 'PTR_SETBOUNDS' else v.origin end as origin, case when p.vid is not null and v.origin = 'SETBOUNDS' then p.t_alloc else v.t_alloc end as t_alloc,
  case when p.vid is not null and v.origin = 'SETBOUNDS' then case when v.t_free < 0 or p.t_free < 0 then -1 else greatest(v.t_free, p.t_free) end else v.t_free end as t_free
 from v left join d on d.dst = v.vid left join v p on p.vid = d.src and p.origin = 'FROMPTR') a
where not (a.origin = 'FROMPTR' and exists (select 1 from d join v k on k.vid = d.dst where d.src = a.vid and k.origin = 'SETBOUNDS'))""")
def graph_fused(spark, sf):
    return G.fuse_bounds(graph_of(spark, sf)).vertices.select("vid", "origin", "t_alloc", "t_free")


@_add("select vid, addr, time from (select vid, addr, arg_max(type, (time, type)) as type, max(time) as time from e where type & 66 <> 0 group by vid, addr) where type & 2 <> 0")
def graph_active_memory(spark, sf):
    return G.active_memory(graph_of(spark, sf).events)


@_add("select min(base) as base, cast(max(base + length) as decimal(21,0)) as top, cast(bit_or(perms) as integer) as perms, 0 as otype from v where origin = 'INITIAL_ROOT'")
def graph_orphans_bound(spark, sf):
    return G.orphans_bound(graph_of(spark, sf).vertices.where("origin = 'INITIAL_ROOT'"))


@_add("select e.vid, base as start, base + length as \"end\", time, case when type & 4 <> 0 then 'load' else 'store' end as kind from e join v using (vid) where type & 12 <> 0")
def graph_deref_map(spark, sf):
    return G.deref_map(graph_of(spark, sf))


@_add("""select l_orderkey, l_linenumber, case when size < 4096 then case when length = size then 'exact' when length < size then 'too_short' else 'too_long' end else 'large' end as verdict
 from (select l_orderkey, l_linenumber, cast(l_quantity as bigint) as length, cast(p_size as bigint) as size from lineitem join part on l_partkey = p_partkey)""")
def verify_lengths(spark, sf):
    t = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    rows = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", F.lit(0).cast("bigint").alias("base"), F.col("l_quantity").cast("bigint").alias("length"), F.col("p_size").cast("bigint").alias("size"), F.lit("OBJECT").alias("type"), F.lit(0).cast("bigint").alias("file_base"), F.array(F.lit(0).cast("bigint")).alias("tops"))
    return verify.bound_verdict(rows).select("l_orderkey", "l_linenumber", "verdict")


@_add("""select user_id, event_id, next_at, outcome from (select user_id, event_id, kind, lead(event_id) over w as next_at, case lead(kind) over w when 'bound' then 'bounded' when 'use' then 'used_before_bound' when 'derive' then 'replaced' else case when lead(kind) over w is null then 'open' else 'dropped' end end as outcome
 from (select user_id, event_id, case event_type when 'signup' then 'derive' when 'purchase' then 'bound' when 'error' then 'use' else 'overwrite' end as kind from events) window w as (partition by user_id order by event_id)) where kind = 'derive'""")
def verify_pending(spark, sf):
    kind = F.when(F.col("event_type") == "signup", "derive").when(F.col("event_type") == "purchase", "bound").when(F.col("event_type") == "error", "use").otherwise("overwrite")
    uses = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", F.lit(0).alias("reg"), kind.alias("kind"))
    return verify.pending(uses, ["user_id"], "event_id").select("user_id", "event_id", "next_at", "outcome")


@_add("""with s as (select user_id, event_id as pos, event_type as kind, cast(json_extract_string(props, '$.k') as bigint) as k from events),
x as (select *, k % 4 + 1 as reg, kind = 'click' and k % 3 = 0 as argument, kind in ('purchase', 'error') or (kind = 'click' and k % 3 <> 0) as reads, kind in ('signup', 'purchase', 'view') or (kind = 'click' and k % 3 = 0) as writes from s),
y as (select *, min(case when reads then pos end) over w as touched, min(case when writes then pos end) over w as written from x window w as (partition by user_id, reg order by pos rows between 1 following and unbounded following)),
o as (select y.*, t.kind as t_kind, t.k as t_k from y left join x t on t.user_id = y.user_id and t.pos = y.touched where y.kind = 'signup' or y.argument)
select user_id, pos as event_id, case when argument then 'andperm' else 'stack' end as part, cast(reg as integer) as reg,
 case when touched is not null and (written is null or touched <= written) then case when argument then case when t_kind = 'click' then 'matched' else 'used' end when t_kind <> 'purchase' then 'used' when t_k % 2 = 1 then 'bounded' else 'wrong_bound' end
  when written is not null then 'overwritten' else 'open' end as outcome,
 case when touched is not null and (written is null or touched <= written) then touched else written end as ended from o""")
def pending_sets(spark, sf):
    """Users as activations, their events as steps on four registers; no moves, so SQL can say it."""
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("bigint")
    reg = (k % 4 + 1).cast("int")
    argument = (kind == "click") & (k % 3 == 0)
    act = F.when(kind == "signup", "offset").when((kind == "purchase") | argument, "bounds").when(kind == "click", "perms").when(kind == "error", "load").otherwise("other")
    dst = F.when(act == "perms", verify.ARGUMENTS).when(act != "load", reg)
    src = F.when((act == "offset") | argument, verify.STACK).when(act.isin("bounds", "perms"), reg)
    size = F.when(act == "offset", 16).otherwise(F.when(k % 2 == 1, 24).otherwise(8)).cast("bigint")
    steps = spark.read.parquet(f"{sf}/events.parquet").select(
        "user_id", F.col("event_id").alias("at"), F.lit(1000).cast("bigint").alias("pc"), act.alias("act"), dst.cast("int").alias("dst"), src.cast("int").alias("src"), size.alias("amount"), F.lit(0).cast("bigint").alias("base"), size.alias("length"),
        F.when(act == "load", F.array(reg)).alias("reads"),
    )
    places = spark.createDataFrame([("v", 0, 4096, 16, 24, None)], "variable string, lowpc long, highpc long, offset long, size long, members array<struct<name:string,offset:bigint,size:bigint>>")
    return verify.pending_sets(steps, places, ["user_id"]).select("user_id", F.col("at").alias("event_id"), F.col("set").alias("part"), "reg", "outcome", "ended")


@_add("""with l as (select *, s_suppkey is not null as known from lineitem left join supplier on s_suppkey = l_suppkey join part on p_partkey = l_partkey),
cv as (select l_orderkey * 8 + l_linenumber as idx, l_suppkey * 100000 + case when l_linenumber % 3 = 0 then 16 when l_quantity = 50 then 92000 else 0 end as base, 50000 + cast(l_quantity as bigint) * 1000 as length, l_suppkey * 100000 as file, l_partkey % 20 * 8 as shift,
 l_linenumber % 2 = 0 as to_file, l_linenumber = 7 as kernel, l_partkey, p_size, cast(l_quantity as bigint) as q from l)
select idx, 'link' as side, base + shift as address, case when base + shift < file or base + shift >= file + 90000 then 'unknown' when base = file and base + length <= file + 90000 then 'correct' else 'incorrect' end as verdict from cv
union all select idx, 'target', case when to_file then file else l_partkey * 512 + 7 + case when q = 13 then 3 else 0 end end,
 case when to_file then case when length <= 90000 then 'correct' else 'incorrect' end when q = 13 then 'unknown' when q = p_size then 'correct' else 'incorrect' end from cv where not kernel""")
def call_verdicts(spark, sf):
    t = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    at = F.col("s_suppkey") * 100000
    files = t("supplier").select(F.col("s_suppkey").alias("ordinal"), F.col("s_name").alias("objfile"), at.alias("file_base"), F.array(at + 60000, at + 90000).alias("tops"))
    parts = t("part").select((F.col("p_partkey") * 512 + 7).alias("addr"), F.col("p_size").cast("bigint").alias("size"), F.lit("OBJECT").alias("type"))
    symbols = parts.unionByName(t("supplier").select(at.alias("addr"), F.lit(0).cast("bigint").alias("size"), F.lit("FUNC").alias("type")))
    line, q, file = F.col("l_linenumber"), F.col("l_quantity").cast("bigint"), F.col("l_suppkey") * 100000
    cap = lambda base, length, offset: F.struct(base.cast("bigint").alias("base"), length.cast("bigint").alias("length"), offset.cast("bigint").alias("offset"))
    link = cap(file + F.when(line % 3 == 0, 16).when(q == 50, 92000).otherwise(0), 50000 + q * 1000, F.col("l_partkey") % 20 * 8)
    to = F.when(line % 2 == 0, file).otherwise(F.col("l_partkey") * 512 + 7 + F.when(q == 13, 3).otherwise(0))
    target = cap(F.when(line == 7, -4096).otherwise(to), F.when(line % 2 == 0, 50000 + q * 1000).otherwise(q), F.lit(0))
    calls = t("lineitem").select((F.col("l_orderkey") * 8 + line).alias("idx"), link.alias("link"), target.alias("target"))
    return verify.call_verdicts(calls, files, symbols)


@_add()
def provenance_vertices(spark, sf):
    """The events as micro-operations on a register per user and a word per value of k; tests compare with a sequential fold."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    kind = F.col("event_type")
    act = F.when(kind == "signup", "root").when(kind == "purchase", "derive").when(kind == "view", "copy").when(kind == "click", F.when(k % 2 == 0, "store").otherwise("load")).otherwise("clear")
    reg = lambda x: F.concat(F.lit("r"), (x % 64).cast("string"))
    n = F.lit(0).cast("bigint")
    uops = spark.read.parquet(f"{sf}/events.parquet").select(
        F.col("event_id").alias("idx"), F.lit(0).alias("sub"), act.alias("act"), reg(F.col("user_id")).alias("dst"), reg(F.col("user_id") + k).alias("src"), (k % 16 * 16).alias("addr"), (F.col("value") > 20).alias("valid"), F.lit("SETBOUNDS").alias("origin"), n.alias("pc"), F.lit(False).alias("is_kernel"),
        n.alias("base"), n.alias("offset"), F.lit(64).cast("bigint").alias("length"), F.lit(7).alias("perms"), F.lit(0).alias("otype"), F.lit(False).alias("sealed"), F.lit(0).alias("flags"), F.col("event_id").alias("time"),
    )
    return provenance.provenance(uops).vertices.select("vid", "origin", "t_alloc", "t_free")
