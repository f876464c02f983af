"""Queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import closure, context, distribution, intervals, lookup, predicates, trace, verify
from ..operators import graph as G
from . import graph_queries, trace_queries

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _add(sql: str | None = None):
    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return _QUERIES | graph_queries.QUERIES | trace_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL | graph_queries.SQL | trace_queries.SQL


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _k() -> F.Column:
    return F.get_json_object("props", "$.k").cast("bigint")


_DUCK_K = "cast(json_extract_string(props, '$.k') as bigint)"


# --- filters and context (C1)
@_add(f"select event_id, user_id, event_type from events where event_type = 'purchase' and value >= 10 and value <= 100 and {_DUCK_K} & 1 <> 0")
def trace_filter_all(spark, sf):
    tests = [F.col("event_type") == "purchase", predicates.in_range(F.col("value"), 10, 100), S.has_any(_k(), 1), None]
    return _t(spark, sf, "events").where(predicates.combine(tests)).select("event_id", "user_id", "event_type")


@_add(f"select event_id, user_id, event_type from events where event_type = 'error' or value > 200 or {_DUCK_K} & 64 <> 0")
def trace_filter_any(spark, sf):
    tests = [F.col("event_type") == "error", F.col("value") > 200, S.has_any(_k(), 64)]
    return _t(spark, sf, "events").where(predicates.combine(tests, match_any=True)).select("event_id", "user_id", "event_type")


@_add("""select event_id, user_id, event_type, hit from (
  select event_id, user_id, event_type, event_type = 'error' as hit,
    max(case when event_type = 'error' then 1 else 0 end) over (partition by user_id order by ts, event_id rows between 2 preceding and 1 following) as near
  from events) where near = 1""")
def trace_context(spark, sf):
    rows = context.with_context(_t(spark, sf, "events"), F.col("event_type") == "error", ["user_id"], ["ts", "event_id"], before=1, after=2)
    return rows.select("event_id", "user_id", "event_type", "hit")


@_add("""with recursive n as (select event_id, user_id, event_type = 'error' as hit, row_number() over (partition by user_id order by ts, event_id) as i from events),
m as (select user_id, i, lead(i) over (partition by user_id order by i) as nx from n where hit),
nxt as (select a.user_id, a.i, (select min(b.i) from m b where b.user_id = a.user_id and b.i > a.i + 2) as j from m a),
anc as (select user_id, min(i) as i from m group by user_id union all select x.user_id, x.j from anc join nxt x on x.user_id = anc.user_id and x.i = anc.i where x.j is not null),
k as (select n.*, (select max(a.i) from anc a where a.user_id = n.user_id and a.i <= n.i) as last, (select min(a.i) from anc a where a.user_id = n.user_id and a.i > n.i) as nexta from n)
select event_id, user_id, case when i = last then 'anchor' when i <= last + 2 then 'after' else 'history' end as kind from k where i <= last + 2 or nexta <= i + 1""")
def trace_context_greedy(spark, sf):
    rows = context.with_greedy_context(_t(spark, sf, "events"), F.col("event_type") == "error", ["user_id"], ["ts", "event_id"], before=1, after=2)
    return rows.select("event_id", "user_id", "kind")


@_add("select event_id, user_id, mode, previous_mode from (select event_id, user_id, event_type as mode, lag(event_type) over (partition by user_id order by ts, event_id) as previous_mode from events) where mode <> previous_mode")
def mode_switch(spark, sf):
    return context.mode_switches(_t(spark, sf, "events"), F.col("event_type"), ["user_id"], ["ts", "event_id"]).select("event_id", "user_id", "mode", "previous_mode")


@_add(f"select event_id, user_id, k, previous_pc from (select event_id, user_id, {_DUCK_K} as k, lag({_DUCK_K}) over (partition by user_id order by ts, event_id) as previous_pc from events) where abs(k - previous_pc) > 40")
def pc_jumps(spark, sf):
    return context.jumps(_t(spark, sf, "events").withColumn("k", _k()), "k", ["user_id"], ["ts", "event_id"], 40).select("event_id", "user_id", "k", "previous_pc")


@_add("""select user_id, cast(bit_or(flag) as bigint) as flags, count(*) filter (flag & 12 <> 0) as derefs, count(distinct case when flag = 2 then k end) as stored
from (select user_id, {0} as k, case event_type when 'view' then 1 when 'purchase' then 2 when 'click' then 4 when 'signup' then 8 else 64 end as flag from events) group by user_id""".format(_DUCK_K))
def event_flags(spark, sf):
    flag = F.create_map(*[F.lit(x) for p in (("view", 1), ("purchase", 2), ("click", 4), ("signup", 8), ("error", 64)) for x in p])[F.col("event_type")]
    events = _t(spark, sf, "events").select("user_id", _k().alias("addr"), flag.alias("type"))
    return G.event_summary(events, "user_id").select("user_id", F.col("flags").cast("bigint").alias("flags"), "derefs", "stored")


@_add("""select cast(sum(case when event_type = 'click' then 1 else 0 end) as bigint) as deref_loads, cast(sum(case when event_type = 'signup' then 1 else 0 end) as bigint) as deref_stores,
  (select cast(sum(n) as bigint) from (select count(distinct {0}) as n from events where event_type = 'purchase' group by user_id)) as stored_addresses,
  count(distinct case when value between 50 and 60 then user_id end) as argument_readers from events""".format(_DUCK_K))
def stats_row(spark, sf):
    flag = F.when(F.col("event_type") == "click", 4).when(F.col("event_type") == "signup", 8).when(F.col("event_type") == "purchase", 2).otherwise(1)
    e = _t(spark, sf, "events").select("user_id", "value", _k().alias("addr"), flag.alias("type"))
    readers = e.where(predicates.in_range(F.col("value"), 50, 60)).agg(F.count_distinct("user_id").alias("argument_readers"))
    sums = G.event_summary(e, "user_id").agg(F.sum("deref_loads").alias("deref_loads"), F.sum("deref_stores").alias("deref_stores"), F.sum("stored").alias("stored_addresses"))
    return sums.join(F.broadcast(readers), F.lit(True))  # one row each


# --- as-of joins and liveness (C2, C3, C6)
@_add("""select e.event_id, e.user_id, p.event_id as def_id from (select * from events where event_type = 'error') e
asof left join (select * from events where event_type = 'purchase') p on e.user_id = p.user_id and e.event_id > p.event_id""")
def asof_last_def(spark, sf):
    e = _t(spark, sf, "events")
    uses = e.where("event_type = 'error'").select("event_id", "user_id")
    defs = e.where("event_type = 'purchase'").select("event_id", "user_id", F.col("event_id").alias("def_id"))
    return lookup.as_of(uses, defs, ["user_id"], "event_id", ["def_id"], strict=True)


@_add("""select e.event_id, e.user_id, s.value as verdict_value, coalesce(s.value < 50, false) as committed from (select * from events where event_type = 'error') e
asof left join (select * from events where event_type = 'signup') s on e.user_id = s.user_id and e.event_id < s.event_id""")
def asof_next_commit(spark, sf):
    e = _t(spark, sf, "events")
    found = lookup.as_of(e.where("event_type = 'error'").select("event_id", "user_id"), e.where("event_type = 'signup'").select("event_id", "user_id", F.col("value").alias("verdict_value")), ["user_id"], "event_id", ["verdict_value"], forward=True, strict=True)
    return found.withColumn("committed", F.coalesce(F.col("verdict_value") < 50, F.lit(False)))


@_add("select event_id, user_id, event_id as t_alloc, coalesce(lead(event_id) over (partition by user_id order by ts, event_id), -1) as t_free from events")
def liveness(spark, sf):
    return intervals.lifetimes(_t(spark, sf, "events").withColumn("t_alloc", F.col("event_id")), "event_id", ["user_id"], ["ts", "event_id"]).select("event_id", "user_id", "t_alloc", "t_free")


@_add("select l_orderkey, l_linenumber, l_extendedprice, o_totalprice from lineitem join orders on l_orderkey = o_orderkey where l_extendedprice > o_totalprice")
def monotonic_check(spark, sf):
    key = lambda line: F.struct(F.col("key"), line.cast("int").alias("line"))
    cents = lambda x: F.round(x * 100).cast("bigint")
    held = lambda vid, top: [vid.alias("vid"), F.lit(0).cast("bigint").alias("base"), cents(top).alias("length"), F.lit(0).alias("perms")]
    orders = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), "o_totalprice").select(*held(key(F.lit(0)), F.col("o_totalprice")))
    lines = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), "l_linenumber", "l_extendedprice").select(*held(key(F.col("l_linenumber")), F.col("l_extendedprice")))
    edges = lines.select(F.struct(F.col("vid.key").alias("key"), F.lit(0).alias("line")).alias("src"), F.col("vid").alias("dst")).distinct()  # lines repeat their keys
    return trace.violations(orders.unionByName(lines), edges).select(F.col("vid.key").alias("l_orderkey"), F.col("vid.line").alias("l_linenumber"), (F.col("top") / 100).alias("l_extendedprice"), (F.col("parent_top") / 100).alias("o_totalprice"))


# --- lineage (C8)
_EDGES = """select 'r' || r_regionkey as src, 'n' || n_nationkey as dst from nation join region on r_regionkey = n_regionkey
union all select 'n' || c_nationkey, 'c' || c_custkey from customer union all select 'c' || o_custkey, 'o' || o_orderkey from orders"""


def _lineage(spark, sf) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    n, c, o = _t(spark, sf, "nation"), _t(spark, sf, "customer"), _t(spark, sf, "orders")
    return n.select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst")).union(c.select(name("n", "c_nationkey"), name("c", "c_custkey"))).union(o.select(name("c", "o_custkey"), name("o", "o_orderkey")))


@_add(f"with recursive e as ({_EDGES}), t as (select 'r' || r_regionkey as id, 0 as depth from region union all select e.dst, t.depth + 1 from t join e on e.src = t.id) select id, depth from t")
def lineage_tree(spark, sf):
    seeds = _t(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"))
    return closure.descendants(_lineage(spark, sf), seeds, forest=True).select("id", "depth")


@_add(f"with recursive e as ({_EDGES}), t as (select 'r' || r_regionkey as id, r_name as seed from region where r_regionkey in (1, 2) union select e.dst, t.seed from t join e on e.src = t.id) select seed, substr(id, 1, 1) as kind, count(*) as n from t group by all")
def lineage_closure(spark, sf):
    seeds = _t(spark, sf, "region").where("r_regionkey in (1, 2)").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("seed"))
    return closure.descendants(_lineage(spark, sf), seeds, ["seed"], forest=True).groupBy("seed", F.substring("id", 1, 1).alias("kind")).agg(F.count("*").alias("n"))


@_add(f"""with recursive e as ({_EDGES}), v as (select 'r' || r_regionkey as id from region union all select dst from e),
t as (select 'r' || r_regionkey as id, 'r' || r_regionkey || ' ' as path, 0 as depth from region union all select e.dst, t.path || e.dst || ' ', t.depth + 1 from t join e on e.src = t.id),
n as (select *, row_number() over (order by path) - 1 as enter from t)
select a.id, a.depth, a.enter, max(b.enter) as leave from n a join n b on starts_with(b.path, a.path) group by all""")
def lineage_preorder(spark, sf):
    edges = _lineage(spark, sf)
    tops = _t(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.lit(None).cast("string").alias("parent"))
    return closure.preorder(edges.select(F.col("dst").alias("id"), F.col("src").alias("parent")).unionByName(tops))


@_add("""with recursive p as (select conv_id, turn, lag(turn) over (partition by conv_id order by turn) as parent from (select distinct conv_id, turn from conversations)),
t as (select conv_id, turn, turn as root, 0 as depth from p where parent is null union all select p.conv_id, p.turn, t.root, t.depth + 1 from t join p on p.conv_id = t.conv_id and p.parent = t.turn)
select conv_id, turn, root, cast(depth as bigint) as depth from t""")
def ancestor_chain(spark, sf):
    from pyspark.sql import Window as W

    turns = _t(spark, sf, "conversations").select("conv_id", "turn").distinct().withColumn("up", F.lag("turn").over(W.partitionBy("conv_id").orderBy("turn")))
    named = turns.select(F.struct("conv_id", "turn").alias("id"), F.when(F.col("up").isNotNull(), F.struct("conv_id", F.col("up").alias("turn"))).alias("parent"))
    return closure.roots_by_doubling(named).select("id.conv_id", "id.turn", F.col("root.turn").alias("root"), "depth")


@_add("""with b as (select event_id, user_id, case when event_type in ('view', 'click') then 1 else -1 end as step from events where event_type in ('view', 'click', 'purchase')),
d as (select *, sum(step) over w as s from b window w as (partition by user_id order by event_id)),
m as (select *, least(0, min(s) over (partition by user_id order by event_id)) as low from d),
lvl as (select *, case when step = 1 then s - low else s - low + 1 end as depth,
  case when step = -1 and s < coalesce(lag(low) over (partition by user_id order by event_id), 0) then false else true end as paired from m)
select o.user_id, o.event_id as opened, (select min(c.event_id) from lvl c where c.user_id = o.user_id and c.step = -1 and c.paired and c.event_id > o.event_id and c.s - c.low < o.s - o.low + (o.low - c.low)
   and c.s = o.s - 1) as closed, cast(o.s - o.low - 1 as integer) as depth from lvl o where o.step = 1""")
def bracket_match(spark, sf):
    e = _t(spark, sf, "events").select("user_id", "event_id", F.col("event_type").isin("view", "click").alias("opens"), (F.col("event_type") == "purchase").alias("closes"))
    return closure.match_brackets(e, ["user_id"], ["event_id"], "opens", "closes")


@_add("""with k as (select unnest(['view', 'click', 'purchase', 'signup']) as reg), e as (select event_id, user_id from events where event_type = 'error'),
c as (select e.event_id, e.user_id, k.reg from e, k), j as (select c.event_id, c.user_id, c.reg, d.event_id as def_id from c asof join (select event_id, user_id, event_type from events) d on c.user_id = d.user_id and c.reg = d.event_type and c.event_id > d.event_id)
select event_id, user_id, count(*) as n_visible, string_agg(reg || ':' || def_id, ',' order by reg) as visible from j group by event_id, user_id""")
def visible_set(spark, sf):
    from pyspark.sql import Window as W

    regs = ("click", "purchase", "signup", "view")
    e = _t(spark, sf, "events").select("event_id", "user_id", "event_type")
    reg = F.array_position(F.array(*map(F.lit, regs)), F.col("event_type")).cast("int") - 1
    spans = e.where(F.col("event_type").isin(*regs)).select("user_id", reg.alias("reg"), F.col("event_id").alias("idx"), F.col("event_id").alias("vid"), F.lit(0).alias("offset"))
    spans = spans.withColumn("until", F.lead("idx").over(W.partitionBy("user_id", "reg").orderBy("idx")))
    calls = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("call"), F.col("event_id").alias("idx"))
    seen = trace.visible_pointers(calls, spans, ["user_id"])
    named = F.transform(F.array_sort(F.collect_list(F.struct(F.col("regs")[0].alias("reg"), "vid"))), lambda x: F.concat(F.element_at(F.array(*map(F.lit, regs)), x["reg"] + 1), F.lit(":"), x["vid"].cast("string")))
    return seen.groupBy("user_id", F.col("call").alias("event_id")).agg(F.count("*").alias("n_visible"), F.array_join(named, ",").alias("visible")).select("event_id", "user_id", "n_visible", "visible")


# --- masks
def _only_vertices(vertices: DataFrame) -> G.Graph:
    """A graph of vertices alone, for what reads no more."""
    return G.Graph(vertices, vertices, vertices, vertices)


@_add("select l_orderkey, l_linenumber from lineitem where not ((l_discount = 0 and l_tax = 0) or l_returnflag = 'R')")
def mask_null(spark, sf):
    lines = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("length"), F.col("l_tax").alias("base"), (F.col("l_returnflag") != "R").alias("valid"))
    return G.without_null(_only_vertices(lines)).vertices.select("l_orderkey", "l_linenumber")


@_add("select o_orderkey, o_orderpriority from orders where o_orderpriority not in ('1-URGENT', '5-LOW')")
def mask_origin(spark, sf):
    orders = _t(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("origin"))
    return G.without_origin("1-URGENT", "5-LOW")(_only_vertices(orders)).vertices.select("o_orderkey", F.col("origin").alias("o_orderpriority"))


@_add("select p_partkey, p_retailprice from part where not (p_retailprice >= 1000 and p_retailprice + p_size <= 1200)")
def mask_range(spark, sf):
    # bounds are whole numbers: prices in cents
    parts = _t(spark, sf, "part").select("p_partkey", F.round(F.col("p_retailprice") * 100).cast("bigint").alias("base"), (F.col("p_size") * 100).cast("bigint").alias("length"))
    return G.without_stack(100_000, 120_000)(_only_vertices(parts)).vertices.select("p_partkey", (F.col("base") / 100).alias("p_retailprice"))


@_add("select o_orderkey from orders o where o_orderdate between timestamp '1996-01-01' and timestamp '1996-03-31' or exists (select 1 from lineitem where l_orderkey = o_orderkey and l_shipdate between timestamp '1996-01-01' and timestamp '1996-03-31')")
def time_slice(spark, sf):
    from datetime import datetime

    orders = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("vid"), F.col("o_orderdate").alias("t_alloc"))
    shipped = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("vid"), F.col("l_shipdate").alias("time"), F.lit(S.EVENTS["deref_load"]).alias("type"))
    g = G.Graph(orders, shipped, orders, orders)
    return G.time_slice(datetime(1996, 1, 1), datetime(1996, 3, 31), deref=True)(g).vertices.select(F.col("vid").alias("o_orderkey"))


@_add("""with b as (select user_id, min(event_id) as at from events where event_type = 'signup' group by user_id)
select distinct e.user_id, e.event_type from events e join b using (user_id) where e.event_id > b.at and not exists (select 1 from events f where f.user_id = e.user_id and f.event_type = e.event_type and f.event_id < b.at)""")
def new_visible(spark, sf):
    e = _t(spark, sf, "events").select("user_id", "event_id", "event_type")
    at = e.where("event_type = 'signup'").groupBy("user_id").agg(F.min("event_id").alias("at"))
    seen = e.join(at, "user_id").where("event_id <> at").select(F.struct("user_id", "event_type").alias("src"), F.col("user_id").alias("dst"), F.when(F.col("event_id") < F.col("at"), G.VISIBLE).otherwise(G.RETURN).alias("op"), F.col("event_id").alias("time"), F.array(F.lit(0)).alias("regs"))
    calls = at.select(F.lit(None).cast(seen.schema["src"].dataType).alias("src"), F.col("user_id").alias("dst"), F.lit(G.SYSCALL).alias("op"), F.col("at").alias("time"), F.array(F.lit(0)).alias("regs"))
    vertices = seen.select(F.col("src").alias("vid")).distinct()
    g = G.kernel_pointers(G.Graph(vertices, vertices, at, seen.unionByName(calls)))
    return g.vertices.where("annotated_ksyscall").select("vid.user_id", "vid.event_type")


@_add("select user_id, arg_min(event_type, event_id) as first_type, min(event_id) as first_id from events where event_type in ('view', 'purchase') group by user_id")
def first_touch(spark, sf):
    e = _t(spark, sf, "events").select(F.col("user_id").alias("vid"), F.col("event_id").alias("time"), F.when(F.col("event_type") == "view", S.EVENTS["load"]).when(F.col("event_type") == "purchase", S.EVENTS["store"]).otherwise(0).alias("type"))
    first = G.first_moves(e)
    return first.select(F.col("vid").alias("user_id"), F.when(S.has_any(F.col("type"), S.EVENTS["load"]), "view").otherwise("purchase").alias("first_type"), F.col("time").alias("first_id"))


@_add("""with w as (select *, lead(event_type) over u as nt, lead(event_id) over u as ni, lead(value) over u as nv, lag(event_type) over u as pt from events window u as (partition by user_id order by event_id))
select event_id, user_id, case when event_type = 'view' and nt = 'purchase' then 'fused' else event_type end as kind, case when event_type = 'view' and nt = 'purchase' then ni end as fused_with
from w where not (event_type = 'purchase' and coalesce(pt = 'view', false))""")
def fuse_pairs(spark, sf):
    from pyspark.sql import Window as W

    e = _t(spark, sf, "events").withColumn("up", F.lag("event_id").over(W.partitionBy("user_id").orderBy("event_id")))
    origin = F.when(F.col("event_type") == "view", "FROMPTR").when(F.col("event_type") == "purchase", "SETBOUNDS").otherwise(F.col("event_type"))
    vertices = e.select(F.col("event_id").alias("vid"), "user_id", "event_type", origin.alias("origin"), F.col("event_id").alias("t_alloc"), F.lit(-1).cast("long").alias("t_free"))
    edges = e.where("up is not null").select(F.col("up").alias("src"), F.col("event_id").alias("dst"), F.lit(0).alias("op"))
    fused = F.col("origin") == "PTR_SETBOUNDS"
    out = G.fuse_bounds(G.Graph(vertices, vertices, vertices, edges)).vertices
    return out.select(F.when(fused, F.col("t_alloc")).otherwise(F.col("vid")).alias("event_id"), "user_id", F.when(fused, "fused").otherwise(F.col("event_type")).alias("kind"), F.when(fused, F.col("vid")).alias("fused_with"))


# --- range joins and lookups (C10, C11)
@_add("select l_orderkey, l_linenumber, p_partkey from lineitem join part on l_extendedprice between p_retailprice and p_retailprice + 0.05")
def range_join_point(spark, sf):
    bands = _t(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("lo"), (F.col("p_retailprice") + 0.05).alias("hi"))
    return lookup.points_in_intervals(_t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), bands, "l_extendedprice", "lo", "hi", 8).select("l_orderkey", "l_linenumber", "p_partkey")


@_add("select a.p_partkey as a_part, s_suppkey as b_supp from part a join supplier b on a.p_retailprice <= b.s_acctbal + 5 and a.p_retailprice + a.p_size >= b.s_acctbal")
def range_join_overlap(spark, sf):
    a = _t(spark, sf, "part").select(F.col("p_partkey").alias("a_part"), F.col("p_retailprice").alias("a0"), (F.col("p_retailprice") + F.col("p_size")).alias("a1"))
    b = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("b_supp"), F.col("s_acctbal").alias("b0"), (F.col("s_acctbal") + 5).alias("b1"))
    return lookup.overlapping(a, b, "a0", "a1", "b0", "b1", 64).select("a_part", "b_supp")


@_add("select l_orderkey, l_linenumber, b.p_size as step from lineitem asof left join (select min(p_size) as p_size, price from (select p_size, min(p_retailprice) as price from part group by p_size) group by price) b on l_extendedprice / 20 >= b.price")
def floor_lookup(spark, sf):
    from pyspark.sql import Window as W

    steps = _t(spark, sf, "part").groupBy("p_size").agg(F.min("p_retailprice").alias("price"))
    steps = steps.withColumn("_n", F.row_number().over(W.partitionBy("price").orderBy("p_size"))).where("_n = 1").drop("_n").withColumnRenamed("p_size", "step")
    left = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 20).alias("v"))
    return lookup.floor_lookup(left, steps, "v", "price", ["step"], 16).select("l_orderkey", "l_linenumber", "step")


@_add("select l_orderkey, l_linenumber, coalesce(p_name, s_name) as symbol from lineitem left join (select p_partkey * 2 as k, p_name from part) on l_partkey = k left join supplier on l_suppkey = s_suppkey")
def symbol_join(spark, sf):
    left = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    a = _t(spark, sf, "part").select((F.col("p_partkey") * 2).alias("l_partkey"), F.col("p_name").alias("symbol"))
    b = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("symbol"))
    return lookup.two_lookups(left, a, ["l_partkey"], b, ["l_suppkey"], "symbol").select("l_orderkey", "l_linenumber", "symbol")


@_add("""with v as (select user_id, event_type, value, row_number() over (partition by user_id order by ts, event_id) as place from events where event_id % 2 = 0),
w as (select user_id, event_type, value, row_number() over (partition by user_id order by ts, event_id) as place from events where event_id % 2 = 1)
select coalesce(v.user_id, w.user_id) as user_id, coalesce(v.place, w.place) as place, concat_ws(',', case when v.event_type is distinct from w.event_type then 'event_type' end, case when v.value is distinct from w.value then 'value' end) as differs
from v full join w on v.user_id = w.user_id and v.place = w.place""")
def zip_compare(spark, sf):
    e = _t(spark, sf, "events").select("user_id", "event_type", "value", "ts", "event_id")
    both = lookup.zip_compare(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id"], ["ts", "event_id"], ["ts", "event_id"], ["event_type", "value"])
    return both.select("user_id", F.col("place").cast("bigint").alias("place"), F.array_join("differs", ",").alias("differs"))


# --- distributions
@_add("""with b as (select l_returnflag, log2(l_extendedprice) as x from lineitem where l_extendedprice > 0),
c as (select l_returnflag, case when x >= 0 and x < 10 then 0 when x >= 10 and x < 12 then 1 when x >= 12 and x < 13 then 2 when x >= 13 and x < 14 then 3 when x >= 14 and x < 15 then 4 when x >= 15 and x <= 64 then 5 end as bin from b)
select l_returnflag, bin, count(*) as n, round(count(*) / sum(count(*)) over (partition by l_returnflag), 9) as share from c where bin is not null group by l_returnflag, bin""")
def log2_histogram(spark, sf):
    h = distribution.log2_histogram(_t(spark, sf, "lineitem"), F.col("l_extendedprice"), ["l_returnflag"], (0, 10, 12, 13, 14, 15, 64))
    return h.withColumn("share", F.round("share", 9))


@_add("""with c as (select cast(p_size as bigint) as size, count(*) as n from part group by all)
select size, n, round(cast(sum(n) over (order by size) as double) / sum(n) over (), 9) as cumulative from c union all select 0, 0, 0.0 union all select min(size), 0, 0.0 from c""")
def size_cdf(spark, sf):
    return distribution.cdf(_t(spark, sf, "part").withColumn("p_size", F.col("p_size").cast("bigint")), "p_size").withColumn("cumulative", F.round("cumulative", 9))


@_add("""with s as (select 'cheap' as split, p_size from part where p_retailprice < 1200 union all select 'large', p_size from part where p_size > 25 union all select 'all', p_size from part),
c as (select split, cast(p_size as bigint) as size, count(*) as n from s group by all)
select split, size, n, round(cast(sum(n) over (partition by split order by size) as double) / sum(n) over (partition by split), 9) as cumulative from c
union all select distinct split, 0, 0, 0.0 from c union all select split, min(size), 0, 0.0 from c group by split""")
def size_cdf_split(spark, sf):
    p = _t(spark, sf, "part").withColumn("p_size", F.col("p_size").cast("bigint"))
    return distribution.split_cdfs(p, "p_size", {"cheap": F.col("p_retailprice") < 1200, "large": F.col("p_size") > 25, "all": F.lit(True)}).withColumn("cumulative", F.round("cumulative", 9))


@_add("""with e as (select l_orderkey as vid, l_linenumber as t, cast(floor(l_extendedprice) as bigint) as addr, case when l_returnflag = 'R' then 36 else 4 end as type from lineitem),
v as (select o_orderkey as vid, cast(0 as bigint) as base, cast(floor(o_totalprice) as bigint) + 200000 as length from orders),
o as (select vid, min(addr) as lo, max(addr) as hi from e group by vid),
w as (select e.vid, o.lo, o.hi, max(type & 32 <> 0 and addr = hi) as cap, max(addr = hi - 8) as m8, max(addr = hi - 4) as m4, max(addr = hi - 1) as m1 from e join o using (vid) group by all),
r as (select vid, lo - base as head, (base + length) - least(hi + case when cap then 32 when m8 then 8 when m4 then 4 when m1 then 1 else 8 end, base + length) as tail from w join v using (vid))
select vid, head, tail, head + tail as total, case when head + tail <= 0 then 0 else cast(floor(log2(head + tail)) as integer) + 1 end as bin from r""")
def headroom(spark, sf):
    events = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("vid"), F.floor("l_extendedprice").cast("bigint").alias("addr"), F.when(F.col("l_returnflag") == "R", 36).otherwise(4).alias("type"))
    vertices = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("vid"), F.lit(0).cast("bigint").alias("base"), (F.floor("o_totalprice").cast("bigint") + 200000).alias("length"))
    return distribution.headroom(vertices, events)


# --- intervals
def _spans(spark, sf) -> DataFrame:
    return _t(spark, sf, "events").select("user_id", F.col("event_id").alias("s"), (F.col("event_id") + F.round("value").cast("bigint")).alias("e"))


_IV = "select user_id, event_id as s, event_id + cast(round(value) as bigint) as e from events"


@_add(f"""with v as ({_IV}), f as (select *, case when s > max(e) over (partition by user_id order by s, e rows between unbounded preceding and 1 preceding) then 1 else 0 end as n from v),
i as (select *, sum(n) over (partition by user_id order by s, e rows unbounded preceding) as g from f) select user_id, min(s) as s, max(e) as e from i group by user_id, g""")
def interval_union(spark, sf):
    return intervals.union(_spans(spark, sf), "s", "e", ["user_id"])


@_add(f"""with v as ({_IV}), p as (select user_id, pt, sum(step) as step from (select user_id, s as pt, 1 as step from v union all select user_id, e, -1 from v) group by all),
c as (select user_id, pt as s, lead(pt) over (partition by user_id order by pt) as e, cast(sum(step) over (partition by user_id order by pt) as bigint) as n from p) select * from c where n > 0""")
def sweep_counts(spark, sf):
    return intervals.sweep(_spans(spark, sf), "s", "e", ["user_id"])


@_add("""with v as (select cast(floor(p_retailprice) as bigint) as s, cast(floor(p_retailprice) as bigint) + p_size as e from part),
f as (select *, case when s > max(e) over (order by s, e rows between unbounded preceding and 1 preceding) then 1 else 0 end as n from v),
i as (select *, sum(n) over (order by s, e rows unbounded preceding) as g from f), u as (select min(s) as a, max(e) as b, true as kept from i group by g),
g as (select lag(b) over (order by a) as a, a as b, false as kept from u), x as (select * from u union all select * from g where a is not null and b > a),
sc as (select *, b - a as size, case when kept then 1.0 else cast(0.05 as double) * sum(case when kept then b - a else 0 end) over () / sum(case when kept then 0 else b - a end) over () end as scale from x),
o as (select *, coalesce(sum(size * scale) over (order by a rows between unbounded preceding and 1 preceding), 0.0) as x0 from sc)
select p_partkey, round(x0 + (p_retailprice - a) * scale, 6) as x from part left join o on p_retailprice >= a and p_retailprice < b""")
def axis_transform(spark, sf):
    p = _t(spark, sf, "part")
    spans = p.select(F.floor("p_retailprice").cast("bigint").alias("s"), (F.floor("p_retailprice").cast("bigint") + F.col("p_size")).alias("e"))
    return intervals.to_axis(p.select("p_partkey", "p_retailprice"), intervals.segments(spans, "s", "e"), "p_retailprice").select("p_partkey", F.round("x", 6).alias("x"))


# --- call graph and verification analogues
@_add("""select src, dst, count(*) as calls, string_agg(cast(t as varchar), ',' order by t) as times from (select event_type as dst, lag(event_type) over (partition by user_id order by event_id) as src, user_id, event_id as t from events) where src is not null group by src, dst, user_id""")
def edge_call_times(spark, sf):
    from pyspark.sql import Window as W

    e = _t(spark, sf, "events").select("user_id", "event_type", "event_id", F.lag("event_type").over(W.partitionBy("user_id").orderBy("event_id")).alias("up"))
    name = lambda c: F.struct("user_id", F.col(c).alias("name"))
    calls = e.select(name("event_type").alias("vid")).distinct().withColumn("address", F.col("vid"))
    edges = e.where("up is not null").select(name("up").alias("src"), name("event_type").alias("dst"), F.lit(G.CALL).alias("op"), F.col("event_id").alias("time"))
    counted = G.call_counts(G.Graph(calls, calls, calls, edges))
    return counted.select(F.col("src.name").alias("src"), F.col("dst.name").alias("dst"), "calls", F.array_join(F.transform("times", lambda x: x.cast("string")), ",").alias("times"))


#: Small parts have exactly their size; the size of a large one, 300 times as big, is rounded out to 8 (the low zeros of such a size).
_CHECK = """case when p_size % 5 = 0 then 'notype' when p_size % 7 = 0 then 'unknown' when p_size < 14 then case when l_quantity = p_size then 'exact' when l_quantity < p_size then 'too_short' else 'too_long' end
 else case when (l_suppkey * 4) & mask <> 0 or (l_suppkey * 4 + cast(l_quantity as bigint) * 300) & mask <> 0 then 'misaligned' when cast(l_quantity as bigint) * 300 < p_size * 300 then 'too_short'
 when (cast(l_quantity as bigint) - p_size) * 300 <= mask then case when l_quantity = p_size then 'exact' else 'padded' end else 'too_long' end end"""
_CHECKED = "(select *, cast(pow(2, greatest(0, 52 - least(53, 65 - (floor(log2(greatest(p_size * 300, 1))) + 1)) + 3)) as bigint) - 1 as mask from lineitem join part on l_partkey = p_partkey)"


def _checked(spark, sf) -> DataFrame:
    n, large = F.col("p_size"), F.col("p_size") >= 14
    joined = _t(spark, sf, "lineitem").join(_t(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    pointers = joined.select(
        "l_orderkey", "l_linenumber", (F.col("l_suppkey") * 4).alias("base"), (F.col("l_quantity").cast("bigint") * F.when(large, 300).otherwise(1)).alias("length"), (n * F.when(large, 300).otherwise(1)).cast("bigint").alias("size"),
        F.when(n % 5 == 0, "NOTYPE").when(n % 7 == 0, "OTHER").otherwise("OBJECT").alias("type"), F.lit(0).cast("bigint").alias("file_base"), F.array(F.lit(0).cast("bigint")).alias("tops"),
    )
    return verify.bound_verdict(pointers).select("l_orderkey", "l_linenumber", "verdict")


@_add(f"select l_orderkey, l_linenumber, {_CHECK} as verdict from {_CHECKED}")
def bound_check(spark, sf):
    return _checked(spark, sf)


@_add(f"""with k as (select unnest(['function', 'notype', 'exact', 'too_short', 'too_long', 'padded', 'misaligned', 'outside', 'unknown']) as verdict), c as (select {_CHECK} as verdict from {_CHECKED})
select k.verdict, count(c.verdict) as n from k left join c on c.verdict = k.verdict group by k.verdict""")
def bound_check_counts(spark, sf):
    return verify.counted(_checked(spark, sf), "verdict")


@_add("""with s as (select event_id, user_id from events where event_type = 'signup')
select s.event_id, s.user_id, coalesce(n.event_type, 'none') as next_use, coalesce(n.event_type = 'purchase', false) as bounded_first from s asof left join (select * from events where event_type in ('purchase', 'error')) n on s.user_id = n.user_id and s.event_id < n.event_id""")
def pending_use(spark, sf):
    e = _t(spark, sf, "events")
    found = lookup.as_of(e.where("event_type = 'signup'").select("event_id", "user_id"), e.where("event_type in ('purchase', 'error')").select("event_id", "user_id", F.col("event_type").alias("next_use")), ["user_id"], "event_id", ["next_use"], forward=True, strict=True)
    return found.select("event_id", "user_id", F.coalesce("next_use", F.lit("none")).alias("next_use"), F.coalesce(F.col("next_use") == "purchase", F.lit(False)).alias("bounded_first"))


@_add("select p_brand, p_type, count(distinct p_size) as sizes, min(p_size) as least, max(p_size) as most from part group by p_brand, p_type having count(distinct p_size) > 1")
def conflict_keys(spark, sf):
    symbols = _t(spark, sf, "part").select(F.col("p_brand").alias("objfile"), F.col("p_type").alias("addr"), F.col("p_size").alias("size"))
    return verify.size_conflicts(symbols).select(F.col("objfile").alias("p_brand"), F.col("addr").alias("p_type"), "sizes", "least", "most")


@_add("""select page_id, regexp_extract(url, '[^/]*$') as file, regexp_replace(regexp_extract(url, '[^/]*$'), '(.)\\.[^.]*$', '\\1') as stem, cast(nullif(regexp_extract(url, '/([0-9]+)[^/]*$', 1), '') as bigint) as number,
 length(html) as length, length(html) - length(replace(html, '<', '')) as tags from pages""")
def text_parse(spark, sf):
    number = S.parse_int(F.regexp_extract("url", r"/([0-9]+)[^/]*$", 1))
    tags = F.char_length("html") - F.char_length(F.replace("html", F.lit("<"), F.lit("")))
    return _t(spark, sf, "pages").select("page_id", S.basename(F.col("url")).alias("file"), S.stem(F.col("url")).alias("stem"), number.alias("number"), F.char_length("html").cast("bigint").alias("length"), tags.cast("bigint").alias("tags"))
