"""Queries of the trace predicates, the graph's annotations and the checks, on the driver's tables.

Events are instructions of a trace: an event's number k chooses opcode, registers
and flags.  Parts, suppliers and line items stand for symbols, object files and
pointers; customers are calls and system calls that see and return orders.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import closure, distribution, intervals, lookup, predicates, trace, verify
from ..operators import graph as G
from . import graph_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_CALL = 1_000_000_000
_OPCODES = ("clc", "csc", "cincoffset", "csetbounds", "lui", "syscall", "cjalr", "cjr", "daddiu", "dmfc0", "cld", "candperm")

_K = "cast(json_extract_string(props, '$.k') as bigint)"
_NAMES = ", ".join(f"'{x}'" for x in _OPCODES)
_VIEWS = f"""t0 as (select event_id as idx, user_id, {_K} as k, value from events),
t as (select *, [{_NAMES}][cast((idx + k) % 12 as integer) + 1] as opcode, case when k % 2 = 0 then 65536 + idx * 4 else -4611686018427387904 + idx * 4 end as pc, 64 + k % 32 as r0, 64 + (k + 1) % 32 as r1, idx % 32 as r2, idx % 2048 as perms,
  case when idx % 13 = 0 then 8 when idx % 17 = 0 then 2 else 31 end as exception from t0),
m as (select *, opcode in ('clc', 'cld') as is_load, opcode = 'csc' as is_store, case when opcode in ('clc', 'cld', 'csc') then user_id * 64 + k end as mem_addr from t)"""

#: Customers as calls: every fifth is an execve, every fifth an mmap, the others are plain.
_GRAPH = f"""cc as (select {_CALL} + c_custkey as vid, case c_custkey % 5 when 0 then 59 when 1 then 477 else cast(c_nationkey as bigint) end as address, case when c_custkey % 7 = 0 then null else c_custkey * 10 + 500 end as t_return, c_custkey % 5 < 2 as sys, c_custkey * 10 as time, c_custkey, c_nationkey from customer),
seen as (select o_orderkey as vid, {_CALL} + o_custkey as call, o_custkey * 10 as time, o_orderkey % 40 as reg from orders where o_orderkey % 3 <> 0), back as (select o_orderkey as vid, {_CALL} + o_custkey as call, o_orderkey % 40 as reg from orders)"""


#: Thirds of the tables lie in user memory and at two places of the kernel's.
_PLACES = (0, -4611686018427387904, -2147483648)


def _place(key: str) -> str:
    return f"(case {key} % 3 when 0 then {_PLACES[0]} when 1 then {_PLACES[1]} else {_PLACES[2]} end)"


def _u(x: str) -> str:
    """An address as the unsigned number that it is."""
    return f"(({x})::hugeint + case when {x} < 0 then 18446744073709551616 else 0 end)"


def _placed(value: Column, key: str) -> Column:
    return value + F.element_at(F.array(*[F.lit(x).cast("bigint") for x in _PLACES]), (F.col(key) % 3 + 1).cast("int"))


def _add(sql: str | None = None, name: str | None = None):
    def keep(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            views = f"{_VIEWS}, {graph_queries._VIEWS}, {_GRAPH}"
            SQL[key] = f"with recursive {views}, {sql[5:]}" if sql.startswith("with ") else f"with recursive {views} {sql}"
        return f

    return keep


def trace_of(spark: SparkSession, sf: str) -> DataFrame:
    """The events as rows of a trace, with k and user_id."""
    k, idx = F.col("k"), F.col("idx")
    op = F.element_at(F.array(*map(F.lit, _OPCODES)), ((idx + k) % 12 + 1).cast("int"))
    operand = lambda reg, perms: F.struct(reg.cast("int").alias("reg_num"), k.alias("imm"), perms.cast("int").alias("perms"))
    t = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("idx"), "user_id", F.get_json_object("props", "$.k").cast("bigint").alias("k")).withColumn("opcode", op)
    load, store = F.col("opcode").isin("clc", "cld"), F.col("opcode") == "csc"
    first = F.when(F.col("opcode") == "lui", k % 2).otherwise(64 + k % 32)
    return t.select(
        "idx", "user_id", "k", idx.alias("cycles"), F.when(k % 2 == 0, 65536 + idx * 4).otherwise(F.lit(-4611686018427387904) + idx * 4).alias("pc"), "opcode",
        F.array(operand(first, idx % 2048), operand(64 + (k + 1) % 32, F.lit(0)), operand(idx % 32, F.lit(0))).alias("ops"), load.alias("is_load"), store.alias("is_store"),
        F.when(load | store, F.col("user_id") * 64 + k).alias("mem_addr"), F.when(idx % 13 == 0, 8).when(idx % 17 == 0, 2).otherwise(31).alias("exception"), k.alias("v0"),
    )


def calls_of(spark: SparkSession, sf: str) -> G.Graph:
    """The graph of orders with customers as calls and system calls that see and return them."""
    g = graph_queries.graph_of(spark, sf)
    c, o = spark.read.parquet(f"{sf}/customer.parquet"), spark.read.parquet(f"{sf}/orders.parquet")
    key, none = F.col("c_custkey"), F.lit(None).cast("bigint")
    address = F.when(key % 5 == 0, G.EXECVE).when(key % 5 == 1, G.MMAP).otherwise(F.col("c_nationkey")).cast("bigint")
    calls = c.select((key + _CALL).alias("vid"), address.alias("address"), F.lit("plain").alias("symbol"), F.lit(None).cast("string").alias("symbol_file"), F.when(key % 7 != 0, key * 10 + 500).alias("t_return"), none.alias("addr_return"), F.lit(0).cast("bigint").alias("frame_base"), F.lit(0).cast("bigint").alias("frame_size"))
    edge = lambda src, dst, op, time, regs: [F.lit(0).cast("bigint").alias("eid"), src.alias("src"), dst.alias("dst"), op.cast("int").alias("op"), time.alias("time"), none.alias("addr"), regs.alias("regs")]
    made = c.select(*edge(F.col("c_nationkey") + F.lit(2 * _CALL), key + _CALL, F.when(key % 5 < 2, G.SYSCALL).otherwise(G.CALL), key * 10, F.lit(None).cast("array<int>")))
    reg = F.array((F.col("o_orderkey") % 40).cast("int"))
    seen = o.where("o_orderkey % 3 <> 0").select(*edge(F.col("o_orderkey"), F.col("o_custkey") + _CALL, F.lit(G.VISIBLE), F.col("o_custkey") * 10, reg))
    back = o.select(*edge(F.col("o_orderkey"), F.col("o_custkey") + _CALL, F.lit(G.RETURN), F.col("o_orderkey"), reg))
    return G.Graph(g.vertices, g.events, calls, g.derivations().unionByName(made).unionByName(seen).unionByName(back), "calls")


# --- predicates of trace rows
def _rows(name: str, test: Callable[[], Column], sql: str) -> None:
    _add(f"select idx, opcode from m where {sql}", name)(lambda spark, sf: trace_of(spark, sf).where(test()).select("idx", "opcode"))


_rows("pred_opcode", lambda: predicates.opcode_is("clc"), "opcode = 'clc'")
_rows("pred_pc", lambda: predicates.pc_in(*predicates.parse_range("65936-0xc000000000000800")), f"(pc >= 65936 or pc < 0) and not (pc < 0 and pc > {0xC000000000000800 - (1 << 64)})")
_rows("pred_access", lambda: predicates.access_in(100, 700), "(is_load or is_store) and mem_addr between 100 and 700")
_rows("pred_register", lambda: predicates.uses_register(70), "(case when opcode = 'lui' then k % 2 else r0 end = 70 or r1 = 70 or r2 = 70)")
_rows("pred_exception", lambda: predicates.exception_is(2), "exception = 2")
_rows("pred_any_exception", lambda: predicates.exception_is(), "exception <> 31")
_rows("pred_syscall", lambda: predicates.syscall_is(), "opcode = 'syscall' and exception = 8")
_rows("pred_syscall_code", lambda: predicates.combine([predicates.syscall_is(3), predicates.syscall_is(58)], match_any=True), "opcode = 'syscall' and exception = 8 and k in (3, 58)")
_rows("pred_operand_permission", lambda: predicates.operand_permission(S.PERMISSIONS["seal"] | S.PERMISSIONS["unseal"]), "perms & 640 <> 0")
_rows("pred_nop", lambda: predicates.is_canonical_nop(), "opcode = 'lui' and k % 2 = 0")
_rows("pred_nop_code", lambda: predicates.is_canonical_nop(42), "opcode = 'lui' and k % 2 = 0 and k = 42")
_rows("user_code", predicates.in_user_code, "pc >= 0")


# --- predicates of vertices and calls
def _vertices(name: str, test: Callable[[], Column], sql: str) -> None:
    _add(f"select vid from v where {sql}", name)(lambda spark, sf: graph_queries.graph_of(spark, sf).vertices.where(test()).select("vid"))


_vertices("pred_origin", lambda: predicates.origin_is("ANDPERM"), "origin = 'ANDPERM'")
_vertices("pred_vertex_pc", lambda: predicates.pc_in(40, 200), "pc between 40 and 200")
_vertices("pred_permission", lambda: predicates.permission_any(S.PERMISSIONS["load"] | S.PERMISSIONS["ccall"]), "perms & 260 <> 0")
_vertices("pred_created", lambda: predicates.created_in(100, 900), "t_alloc between 100 and 900")
_vertices("pred_length", lambda: predicates.length_in(10, 40), "length between 10 and 40")
_vertices("pred_lifetime", lambda: predicates.lifetime_in(200, None), "t_free < 0 or t_free - t_alloc >= 200")


@_add("select vid from v where vid % 4 = 3")
def pred_object_type(spark, sf):
    vertices = graph_queries.graph_of(spark, sf).vertices.withColumn("otype", (F.col("vid") % 4).cast("int"))
    return vertices.where(predicates.object_type_is(3)).select("vid")


@_add("select vid from v where vid in (select vid from e where type & 2 <> 0 and addr between 1000 and 20000)")
def pred_stored(spark, sf):
    g = graph_queries.graph_of(spark, sf)
    return predicates.with_event(g.vertices, g.events, S.EVENTS["store"], 1000, 20000).select("vid")


@_add("select vid from v where vid in (select vid from e where type & 12 <> 0 and addr between 1000 and 20000)")
def pred_dereferenced(spark, sf):
    g = graph_queries.graph_of(spark, sf)
    return predicates.with_event(g.vertices, g.events, S.EVENTS["deref_load"] | S.EVENTS["deref_store"], 1000, 20000).select("vid")


@_add("select vid from cc where sys")
def pred_call_type(spark, sf):
    g = calls_of(spark, sf)
    return predicates.call_type_is(g.calls, g.edges, G.SYSCALL).select("vid")


@_add("select vid from c where symbol = 'malloc'")
def pred_call_target(spark, sf):
    return graph_queries.graph_of(spark, sf).calls.where(predicates.call_target_is("malloc")).select("vid")


@_add("select vid, 'prov' as layer from v where origin = 'ROOT'")
def pred_layer(spark, sf):
    g = graph_queries.graph_of(spark, sf)
    both = g.vertices.select("vid", F.lit("prov").alias("layer"), "origin").unionByName(g.calls.select("vid", F.lit("call").alias("layer"), F.lit("ROOT").alias("origin")))
    return both.where(predicates.layer_is("prov") & predicates.origin_is("ROOT")).select("vid", "layer")


# --- masks and annotations that need calls
@_add("select vid, 'prov' as layer from v where not (t_alloc < 900) union all select vid, 'call' from cc where time >= 900")
def mask_before_execve(spark, sf):
    g = G.without_before_execve(900)(calls_of(spark, sf))
    return g.vertices.select("vid", F.lit("prov").alias("layer")).unionByName(g.calls.select("vid", F.lit("call").alias("layer")))


_KSYS = "ks as (select distinct b.vid from back b join cc on cc.vid = b.call and cc.sys and cc.time >= 300 where b.reg < 34 and not exists (select 1 from seen s where s.vid = b.vid and s.call = b.call and s.reg < 34))"
_KORI = "ko as (select vid from (select e.vid, arg_min(type & 1, (time, type)) as l from e join v using (vid) where type & 128 <> 0 and type & 3 <> 0 and is_kernel group by e.vid) where l = 1)"


def _used(spark: SparkSession, sf: str) -> G.Graph:
    """Calls' graph whose events are moves by user code: a load for an odd address, else a store."""
    g = calls_of(spark, sf)
    moves = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("vid"), (F.col("l_partkey") * 8 + F.col("l_linenumber")).cast("bigint").alias("time"), F.floor("l_extendedprice").cast("bigint").alias("addr"), F.when(F.floor("l_extendedprice") % 2 == 1, 129).otherwise(130).alias("type"))
    return replace(g, events=moves)


_MOVES = "mv as (select l_orderkey as vid, l_partkey * 8 + l_linenumber as time, case when cast(floor(l_extendedprice) as bigint) % 2 = 1 then 1 else 0 end as is_load from lineitem), kf as (select vid, time, min(is_load) as l from mv join (select vid as w, min(time) as f from mv group by vid) on vid = w and time = f group by vid, time), ko as (select vid from kf join v using (vid) where is_kernel and l = 1)"


@_add(f"with {_KSYS} select vid, vid in (select vid from ks) as ksyscall from v")
def kernel_pointers(spark, sf):
    return G.kernel_pointers(calls_of(spark, sf), 300).vertices.select("vid", F.col("annotated_ksyscall").alias("ksyscall"))


@_add(f"with {_MOVES} select vid, vid in (select vid from ko) as korigin from v")
def first_used_by_user(spark, sf):
    return G.first_used_by_user(_used(spark, sf)).vertices.select("vid", F.col("annotated_korigin").alias("korigin"))


@_add(f"with {_KSYS}, {_MOVES} select vid from v where not (is_kernel and vid not in (select vid from ks) and vid not in (select vid from ko))")
def mask_unused_kernel(spark, sf):
    return _used(spark, sf).transform(lambda g: G.kernel_pointers(g, 300), G.first_used_by_user, G.without_unused_kernel).vertices.select("vid")


@_add("""with s as (select b.vid, b.call from back b join cc on cc.vid = b.call where cc.address = 477 and b.reg = 3), tr as (select vid, call, 0 as far from s union all select d.dst, tr.call, far + 1 from tr join d on d.src = tr.vid),
n as (select vid, min(call) as call from (select *, min(far) over (partition by vid) as least from tr) where far = least group by vid) select v.vid, coalesce(n.call, -1) as mmap from v left join n using (vid)""")
def mmap_sources(spark, sf):
    return G.mmap_sources()(calls_of(spark, sf)).vertices.select("vid", F.col("annotated_mmap").alias("mmap"))


@_add("""with l as (select vid, time, t_return from cc where address = 59 and sys order by t_return desc nulls last, time desc limit 1) select l.vid, l.time, l.t_return, b.vid as stack from l left join back b on b.call = l.vid and b.reg = 11""")
def last_execve(spark, sf):
    return G.last_execve(calls_of(spark, sf)).select("vid", "time", "t_return", "stack")


@_add("select vid, addr between 3000 and 30000 as hit from (select e.vid, max(addr) filter (type & 12 <> 0 and addr between 3000 and 30000) as addr from e join v using (vid) group by e.vid) where addr is not null")
def stack_touched(spark, sf):
    g = G.touches_stack(3000, 30000)(graph_queries.graph_of(spark, sf))
    return g.vertices.where("annotated_stack_all").select("vid", F.col("annotated_stack_all").alias("hit"))


@_add("select vid, base >= 1000 and base + length <= 90000 as inside, perms & 2 <> 0 as exec from v")
def bounds_and_exec(spark, sf):
    g = graph_queries.graph_of(spark, sf).transform(G.in_bounds("inside", 1000, 90000), G.executable)
    return g.vertices.select("vid", F.col("annotated_inside").alias("inside"), F.col("annotated_exec").alias("exec"))


#: The graph's pointers at user and kernel addresses; every fiftieth reaches over all of memory.
_WIDE = f"""pv as (select * exclude (base, length), case when vid % 50 = 0 then 0 else base + {_place('vid')} end as base, case when vid % 50 = 0 then -1 else length end as length from v),
pe as (select vid, time, addr + {_place('vid')} as addr, type from e)"""


def _wide(g: G.Graph) -> G.Graph:
    whole = F.col("vid") % 50 == 0
    vertices = g.vertices.withColumn("base", F.when(whole, 0).otherwise(_placed(F.col("base"), "vid"))).withColumn("length", F.when(whole, -1).otherwise(F.col("length")))
    return replace(g, vertices=vertices, events=g.events.withColumn("addr", _placed(F.col("addr"), "vid")))


_TABLES = f"tb as (select a, a + 900 as b from (select cast(floor(s_acctbal) as bigint) * 20 + {_place('s_suppkey')} as a from supplier))"


def _tables(spark: SparkSession, sf: str) -> DataFrame:
    start = _placed(F.floor("s_acctbal").cast("bigint") * 20, "s_suppkey")
    return spark.read.parquet(f"{sf}/supplier.parquet").select(start.alias("start"), (start + 900).alias("end"))


@_add(f"""with {_WIDE}, {_TABLES}, ub as (select {_u('a')} as a, {_u('b')} as b from tb), ld as (select distinct vid from pe where type & 32 <> 0 and exists (select 1 from ub where {_u('addr')} between a and b)),
pt as (select vid from pv where exists (select 1 from ub where {_u('base')} >= a and {_u('base')} + {_u('length')} <= b)),
tr as (select vid from ld union select d.dst from tr join d on d.src = tr.vid) select vid, vid in (select vid from ld) as globptr, vid in (select vid from pt) as captblptr, vid in (select vid from tr) and vid not in (select vid from ld) as globderived from v""")
def global_pointers(spark, sf):
    g = _wide(graph_queries.graph_of(spark, sf))
    loads = g.events.withColumn("type", F.when(S.has_any(F.col("type"), 32), 1).otherwise(0))
    g = G.global_pointers(_tables(spark, sf))(replace(g, events=loads))
    return g.vertices.select("vid", *[F.col(f"annotated_{n}").alias(n) for n in ("globptr", "captblptr", "globderived")])


_BEYOND = f"{_u('c.base')} < {_u('p.base')} or {_u('c.base')} + {_u('c.length')} > {_u('p.base')} + {_u('p.length')} or c.perms & ~p.perms <> 0"


@_add(f"with {_WIDE} select d.dst as vid, d.src as parent, c.base, p.base as parent_base from d join pv p on p.vid = d.src join pv c on c.vid = d.dst where {_BEYOND}")
def derivation_violations(spark, sf):
    g = _wide(graph_queries.graph_of(spark, sf))
    return trace.violations(g.vertices, g.derivations()).select("vid", "parent", "base", "parent_base")


@_add(f"""with {_WIDE} select vid, {_u('base')} >= {_u(str(_PLACES[1]))} + 1000 and {_u('base')} + {_u('length')} <= {_u(str(_PLACES[1]))} + 90000 as inside,
 not ({_u('base')} >= 1000 and {_u('base')} + {_u('length')} <= {_u(str(_PLACES[2]))} + 90000) as kept from pv""")
def kernel_bounds(spark, sf):
    g = _wide(graph_queries.graph_of(spark, sf)).transform(G.in_bounds("inside", _PLACES[1] + 1000, _PLACES[1] + 90000))
    kept = G.without_stack(1000, _PLACES[2] + 90000)(g).vertices.select("vid", F.lit(True).alias("kept"))
    return g.vertices.select("vid", F.col("annotated_inside").alias("inside")).join(kept, "vid", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


@_add("with rl as (select distinct cast(floor(p_retailprice) as bigint) * 30 as target from part) select vid, vid in (select vid from e where type & 2 <> 0 and addr in (select target from rl)) as capreloc, vid in (select vid from e where type & 40 <> 0 and addr in (select target from rl)) as capreloc_ptr from v")
def relocation_pointers(spark, sf):
    targets = spark.read.parquet(f"{sf}/part.parquet").select((F.floor("p_retailprice").cast("bigint") * 30).alias("target")).distinct()
    g = G.relocations(targets)(graph_queries.graph_of(spark, sf))
    return g.vertices.select("vid", F.col("annotated_capreloc").alias("capreloc"), F.col("annotated_capreloc_ptr").alias("capreloc_ptr"))


@_add("select cc.vid, case when not cc.sys then coalesce(n_name, 'plain') else 'plain' end as symbol from cc left join (select n_nationkey * 2 as place, n_name from nation) on place = address")
def call_symbols(spark, sf):
    names = spark.read.parquet(f"{sf}/nation.parquet").select((F.col("n_nationkey") * 2).cast("bigint").alias("addr"), F.col("n_name").alias("name"), F.lit("libc").alias("file"))
    return G.call_symbols(names)(calls_of(spark, sf)).calls.select("vid", "symbol")


@_add("""with s as (select vid, (select min(cc.vid) from cc where v.t_alloc >= cc.time and (cc.t_return is null or v.t_alloc <= cc.t_return)) as call from v)
select s.vid, case when cc.t_return is not null then cc.vid end as call, case when cc.t_return is not null then cc.address end as address from s join cc on cc.vid = s.call""")
def call_at_creation(spark, sf):
    g = calls_of(spark, sf)
    return G.call_at(g.vertices, g)


@_add("select 2000000000 + c_nationkey as src, address as dst, count(*) as calls, min(time) as first_call, max(time) as last_call from cc group by all")
def call_count_by_address(spark, sf):
    g = calls_of(spark, sf)
    outer = spark.read.parquet(f"{sf}/nation.parquet").select((F.col("n_nationkey") + F.lit(2 * _CALL)).alias("vid")).withColumn("address", F.col("vid"))
    counted = G.call_counts(replace(g, calls=g.calls.select("vid", "address").unionByName(outer)))
    return counted.select("src", "dst", "calls", F.col("times")[0].alias("first_call"), F.element_at("times", -1).alias("last_call"))


@_add("select vid, base as start, base + length as \"end\", t_alloc as time, perms & 14 as colour from v")
def address_map(spark, sf):
    return G.address_map(graph_queries.graph_of(spark, sf))


@_add("select vid, addr, time, 'store' as kind from e where type & 2 <> 0")
def access_map(spark, sf):
    return G.access_map(graph_queries.graph_of(spark, sf))


@_add("select min(base) as min_start, max(base) as max_start, min(base + length) as min_end, max(base + length) as max_end from v")
def map_view_box(spark, sf):
    return G.view_box(G.address_map(graph_queries.graph_of(spark, sf)), ["start", "end"])


@_add("with h as (select vid, time, addr from e where vid in (select vid from v where origin not in ('FROMPTR', 'ROOT', 'INITIAL_ROOT'))) select vid, count(*) as events from h group by vid")
def purged_events(spark, sf):
    g = graph_queries.graph_of(spark, sf).transform(G.without_fromptr, G.without_roots).purge()
    return g.events.groupBy("vid").agg(F.count("*").alias("events"))


@_add("select distinct src as id from d where src not in (select dst from d where src is not null)")
def derivation_roots(spark, sf):
    return closure.roots(graph_queries.graph_of(spark, sf).derivations())


@_add("with f as (select dst as vid, min(src) as parent from d where src is not null group by dst), n as (select f.vid, f.parent from f) select vid, parent as other, 'in' as way from n union all select src, dst, 'out' from d where src is not null")
def derivation_neighbours(spark, sf):
    edges = graph_queries.graph_of(spark, sf).derivations()
    parent = closure.first_parent(edges).select("vid", F.col("parent").alias("other"), F.lit("in").alias("way"))
    vertices = edges.select(F.col("src").alias("vid")).distinct()
    return parent.unionByName(closure.neighbours(vertices, edges).select("vid", "other", F.lit("out").alias("way")))


# --- distributions
@_add("""with z as (select case when origin = 'ROOT' then 1099511627776 else length end as size, count(*) as n from v group by 1), w as (select size, n, cast(sum(n) over (order by size) as double) / sum(n) over () as cumulative from z)
select size, n, round(cumulative, 9) as cumulative from w union all select 0, 0, 0.0 union all select min(size), 0, 0.0 from z""")
def bounds_substituted(spark, sf):
    v = distribution.substituted_bounds(graph_queries.graph_of(spark, sf).vertices, F.col("origin") == "ROOT", 0, 1 << 40)
    return distribution.cdf(v, "length").withColumn("cumulative", F.round("cumulative", 9))


@_add("select l_returnflag, bin, n, cast(sum(n) over (partition by l_returnflag order by bin) as bigint) as \"to\", cast(sum(n) over (partition by l_returnflag order by bin) as bigint) - n as \"from\" from (select l_returnflag, case when l_quantity < 2 then 0 when l_quantity < 8 then 1 when l_quantity < 32 then 2 else 3 end as bin, count(*) as n from lineitem where l_quantity > 0 group by all)")
def bars_stacked(spark, sf):
    bins = distribution.log2_histogram(spark.read.parquet(f"{sf}/lineitem.parquet"), F.col("l_quantity"), ["l_returnflag"], (-64, 1, 3, 5, 64))
    return distribution.stacked(bins.drop("share"), ["l_returnflag"])


@_add("with x as (select distinct l_orderkey * 10 as s, l_orderkey * 10 + l_partkey * 7 as e from lineitem) select s, e from x where e - s <= 2000 union select s, s + 1000 from x where e - s > 2000 union select e - 1000, e from x where e - s > 2000")
def large_range_ends(spark, sf):
    spans = spark.read.parquet(f"{sf}/lineitem.parquet").select((F.col("l_orderkey") * 10).alias("s"), (F.col("l_orderkey") * 10 + F.col("l_partkey") * 7).alias("e"))
    return intervals.ends_of_large(spans, "s", "e", 1000)


# --- checks of bounds
_SYMBOL = "case when p_size % 3 = 0 then p_size * 400 else p_size end"


@_add(f"""with j as (select l_orderkey, l_linenumber, p_size % 7 as kind, {_SYMBOL} as size, cast(l_quantity as bigint) * case when p_size % 3 = 0 then 400 else 1 end as length, l_suppkey * case when l_linenumber % 2 = 0 then 4096 else 24 end as base from lineitem join part on l_partkey = p_partkey),
k as (select *, cast(pow(2, greatest(0, 52 - least(53, 65 - (floor(log2(size)) + 1)) + 3)) as bigint) - 1 as mask from j)
select l_orderkey, l_linenumber, case when kind = 0 then case when base = 4096 and base + length <= 12000 then 'function' else 'outside' end when kind = 1 then 'notype' when kind = 2 then 'unknown'
 when size < 4096 then case when length = size then 'exact' when length < size then 'too_short' else 'too_long' end
 when base & mask <> 0 or (base + length) & mask <> 0 then 'misaligned' when length < size then 'too_short' when length - size <= mask then case when length = size then 'exact' else 'padded' end else 'too_long' end as verdict from k""")
def bound_verdicts(spark, sf):
    t = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    big = F.col("p_size") % 3 == 0
    kind = F.col("p_size") % 7
    rows = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey", "l_linenumber", (F.col("l_suppkey") * F.when(F.col("l_linenumber") % 2 == 0, 4096).otherwise(24)).alias("base"), (F.col("l_quantity").cast("bigint") * F.when(big, 400).otherwise(1)).alias("length"), F.when(big, F.col("p_size") * 400).otherwise(F.col("p_size")).cast("bigint").alias("size"),
        F.when(kind == 0, "FUNC").when(kind == 1, "NOTYPE").when(kind == 2, None).otherwise("OBJECT").alias("type"), F.lit(4096).cast("bigint").alias("file_base"), F.array(F.lit(8000).cast("bigint"), F.lit(12000).cast("bigint")).alias("tops"),
    )
    return verify.bound_verdict(rows).select("l_orderkey", "l_linenumber", "verdict")


@_add(f"""with f as (select s_suppkey as ordinal, s_name as objfile, {_u('lo')} as lo, {_u('lo + 2999')} as hi from (select *, cast(floor(s_acctbal) as bigint) * 10 + {_place('s_suppkey')} as lo from supplier)),
p as (select *, cast(floor(l_extendedprice) as bigint) + {_place('l_suppkey')} as addr from lineitem)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, (select arg_min(objfile, ordinal) from f where {_u('addr')} between lo and hi) as objfile from p""")
def object_file_of(spark, sf):
    lo = _placed(F.floor("s_acctbal").cast("bigint") * 10, "s_suppkey")
    files = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("ordinal"), F.col("s_name").alias("objfile"), lo.alias("file_base"), F.array(lo + 1000, lo + 3000).alias("tops"))
    points = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", _placed(F.floor("l_extendedprice").cast("bigint"), "l_suppkey").alias("addr"))
    return verify.object_files(points, files, "addr").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "objfile")


@_add(f"""with s as (select {_u('a')} as a, p_partkey, p_size from (select p_partkey * 96 + {_place('p_partkey')} as a, p_partkey, p_size from part)),
x as (select *, l_partkey * 96 + cast(l_quantity as bigint) * 7 - 100 + {_place('l_partkey')} as v from lineitem)
select l_orderkey, l_linenumber, l_partkey, v, s.p_partkey as part, s.p_size as size from x asof left join s on {_u('v')} >= s.a""")
def floor_lookup_addresses(spark, sf):
    steps = spark.read.parquet(f"{sf}/part.parquet").select(_placed(F.col("p_partkey") * 96, "p_partkey").alias("at"), F.col("p_partkey").alias("part"), F.col("p_size").alias("size"))
    values = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", _placed(F.col("l_partkey") * 96 + F.col("l_quantity").cast("bigint") * 7 - 100, "l_partkey").alias("v"))
    return lookup.floor_lookup(values, steps, "v", "at", ["part", "size"], 64, unsigned=True)


@_add("""with s as (select p_brand as objfile, p_type as name, p_partkey + p_partkey % 2 as addr, max(p_size) as size from part group by all), rl as (select cast(o_orderkey as bigint) as addr, max(o_custkey) as length from orders group by 1)
select l_orderkey, l_linenumber, l_suppkey, coalesce(s.size, rl.length) as size, case when s.size is not null then 'OBJECT' when rl.length is not null then 'OBJECT' end as type
from lineitem join part on p_partkey = l_partkey left join s on s.objfile = p_brand and s.name = p_type and s.addr = l_partkey left join rl on rl.addr = l_partkey""")
def symbol_sizes(spark, sf):
    t = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    parts = t("part").select(F.col("p_brand").alias("objfile"), F.col("p_type").alias("name"), F.col("p_partkey").alias("addr"), F.col("p_size").cast("bigint").alias("size"), F.lit("OBJECT").alias("type"))
    pointers = t("lineitem").join(parts, F.col("l_partkey") == F.col("addr")).select("l_orderkey", "l_linenumber", "l_suppkey", "objfile", "name", "addr")
    relocs = t("orders").select(F.col("o_orderkey").alias("target"), F.col("o_custkey").alias("length"))
    return verify.symbols_of(pointers, parts.withColumn("addr", F.col("addr") + F.col("addr") % 2), relocs).select("l_orderkey", "l_linenumber", "l_suppkey", "size", "type")


@_add(f"with {_TABLES} select l_orderkey, l_linenumber, l_partkey, l_suppkey, exists (select 1 from (select {_u('a')} as a, {_u('b')} as b from tb) where {_u('x')} between a and b) as in_table from (select *, cast(floor(l_extendedprice) as bigint) + {_place('l_suppkey')} as x from lineitem)")
def table_pointers(spark, sf):
    points = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", _placed(F.floor("l_extendedprice").cast("bigint"), "l_suppkey").alias("cursor"))
    return verify.table_pointer_checks(points, _tables(spark, sf)).drop("cursor")


@_add("""with l as (select p_partkey * 40 as lo, p_partkey * 40 + p_size * 4 as hi, p_size % 4 as reg, cast(p_size as bigint) as n from part)
select e.event_id, l.lo, case when x.len = l.n then 'exact' when x.len < l.n then 'too_short' else 'too_long' end as verdict
from events e, lateral (select e.event_id * 4 as pc, e.user_id % 4 as reg, cast(round(e.value) as bigint) % 50 as len) x join l on x.pc >= l.lo and x.pc < l.hi - 4 and x.reg = l.reg""")
def live_variables(spark, sf):
    pointers = spark.read.parquet(f"{sf}/events.parquet").select("event_id", (F.col("event_id") * 4).alias("pc"), (F.col("user_id") % 4).alias("reg"), F.lit(0).cast("bigint").alias("base"), (F.round("value").cast("bigint") % 50).alias("length"))
    at = F.col("p_partkey") * 40
    places = spark.read.parquet(f"{sf}/part.parquet").select(at.alias("lowpc"), (at + F.col("p_size") * 4).alias("highpc"), (F.col("p_size") % 4).cast("bigint").alias("cap_register"), F.col("p_size").cast("bigint").alias("expected_length"))
    return verify.live_variable_lengths(pointers, places).select("event_id", F.col("lowpc").alias("lo"), "verdict")


@_add("select 'link' as side, count(*) as n from events where event_id % 3 <> 0 union all select 'target', count(*) from events where user_id % 2 = 0")
def call_sides(spark, sf):
    cap = lambda base: F.struct(base.cast("bigint").alias("base"), F.lit(16).cast("bigint").alias("length"))
    calls = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("idx"), cap(F.when(F.col("event_id") % 3 == 0, -4096).otherwise(F.col("event_id"))).alias("link"), cap(F.when(F.col("user_id") % 2 == 1, -4096).otherwise(F.col("user_id"))).alias("target"))
    return verify.call_checks(calls).groupBy("side").agg(F.count("*").alias("n"))


@_add("""with s as (select p_brand as objfile, p_name as name, p_partkey * 16 as addr, p_size as size, case when p_size % 3 = 0 then 'FUNC' else 'OBJECT' end as type from part),
p as (select l_orderkey, l_linenumber, l_partkey * 16 as addr, cast(l_quantity as bigint) as length from lineitem), x as (select p.*, s.size, s.type from p left join s using (addr))
select case when type is null then 'unknown' when type = 'FUNC' then case when length <= 30 then 'function' else 'outside' end when length = size then 'exact' when length < size then 'too_short' else 'too_long' end as verdict, count(*) as n from x group by 1""")
def static_table_totals(spark, sf):
    t = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    symbols = t("part").select(F.lit("a.out").alias("objfile"), F.col("p_name").alias("name"), (F.col("p_partkey") * 16).alias("addr"), F.col("p_size").cast("bigint").alias("size"), F.when(F.col("p_size") % 3 == 0, "FUNC").otherwise("OBJECT").alias("type"))
    table = t("lineitem").select("l_orderkey", (F.col("l_partkey") * 16).alias("slot"), F.lit(0).cast("bigint").alias("base"), F.col("l_quantity").cast("bigint").alias("length"))
    checked = verify.static_table_check(table, symbols, F.lit(0).cast("bigint"), F.array(F.lit(30).cast("bigint")))
    return verify.counted(checked, "verdict").where("n > 0")


# --- the order of a trace
@_add("select idx, previous as last_opcode, previous in ('cjalr', 'cjr') as in_delay_slot from (select idx, lag(opcode) over (order by idx) as previous from t) where previous is not null")
def delay_slots(spark, sf):
    return trace.with_delay_slots(trace_of(spark, sf), 100).where("last_opcode is not null").select("idx", "last_opcode", "in_delay_slot")


@_add("with w as (select idx, r0, k from t where opcode <> 'lui') select idx, r0 as reg_num, k as gpr_val, lead(idx) over (partition by r0 order by idx) as until from w")
def register_spans(spark, sf):
    rows = trace_of(spark, sf).where("opcode <> 'lui'").select("idx", F.col("ops")[0]["reg_num"].alias("reg_num"), F.col("k").alias("gpr_val"), F.lit(None).alias("cap"))
    return trace.register_versions(rows).select("idx", F.col("reg_num").cast("bigint").alias("reg_num"), "gpr_val", "until")


@_add("select c, count(*) as n from t, (values ('load', 'clc'), ('load', 'cld'), ('store', 'csc'), ('arith', 'cincoffset'), ('bound', 'csetbounds'), ('bound', 'candperm'), ('flow', 'cjalr'), ('flow', 'cjr'), ('cap', 'clc'), ('cap', 'cld'), ('cap', 'csc'), ('cap', 'cincoffset'), ('cap', 'csetbounds'), ('cap', 'candperm'), ('cap', 'cjalr'), ('cap', 'cjr')) as x(c, o) where o = opcode group by c union all select 'all', count(*) from t")
def instruction_classes(spark, sf):
    rows = trace.classified(trace_of(spark, sf))
    return rows.select(F.explode("classes").alias("c")).groupBy("c").agg(F.count("*").alias("n"))


@_add("select idx, '{0:' || idx || '} 0x' || lower(case when pc >= 0 then printf('%x', pc) else printf('%x', pc) end) || ' ' || opcode || case when exception <> 31 then ' except:' || exception else '' end || coalesce(' (' || n_name || ')', '') || case when is_load then chr(10) || '$load [0x' || printf('%x', mem_addr) || ']' when is_store then chr(10) || '$store [0x' || printf('%x', mem_addr) || ']' else '' end as line from m left join (select n_name, 65536 + n_nationkey * 40 as place from nation) on place = pc")
def trace_lines(spark, sf):
    names = spark.read.parquet(f"{sf}/nation.parquet").select((F.col("n_nationkey").cast("bigint") * 40 + 65536).alias("addr"), F.col("n_name").alias("name"))
    rows = trace_of(spark, sf).withColumn("asid", F.lit(0))
    return trace.dump_lines(rows, names)


@_add("select pc, arg_min(k, idx) as frame_size from t where k > 0 and opcode = 'daddiu' and r2 = 29 group by pc")
def frame_sizes(spark, sf):
    rows = trace_of(spark, sf).withColumn("opcode", F.when(F.col("opcode") == "daddiu", "addiu").otherwise(F.col("opcode")))
    own = rows.withColumn("ops", F.array(F.struct(F.col("ops")[2]["reg_num"].alias("reg_num"), (-F.col("k")).alias("imm"), F.lit(0).alias("perms"))))
    return trace.frame_sizes(own)


# --- what tools compose
@_add("""select vid, origin, base >= 1000 and base + length <= 50000 or vid in (select vid from e where type & 12 <> 0 and addr between 1000 and 50000) as stack, perms & 2 <> 0 as exec
 from v where not ((length = 0 and base = 0) or not valid) and origin not in ('ROOT', 'INITIAL_ROOT', 'ANDPERM') and not (pc <> 0 and is_kernel) and (t_alloc between 100 and 5000 or vid in (select vid from e where time between 2 and 3 and type & 12 <> 0))""")
def graph_filters(spark, sf):
    g = graph_queries.graph_of(spark, sf).transform(G.filters(null=True, roots=True, andperm=True, kernel=True, mark_exec=True))
    one = G.filters(times=(100, 5000))(g).vertices.unionByName(G.filters(times=(2, 3), by=("deref",))(g).vertices).distinct()
    marked = G.filters(mark_stack=(1000, 50000))(replace(g, vertices=one, edges=g.edges.limit(0)))
    return marked.vertices.select("vid", "origin", (F.col("annotated_stack") | F.col("annotated_stack_all")).alias("stack"), F.col("annotated_exec").alias("exec"))


@_add(f"""with {_TABLES}, w as (select {_u('a')} as a, max({_u('b')}) as b from tb where {_u('a')} <= {_u('b')} group by 1),
l as (select event_id, user_id, user_id * 37 + {_place('user_id')} as cursor, case when event_id % 4 = 0 then 900 else event_id % 1000 end as length, event_id % 5 = 0 as is_kernel from events where event_type <> 'signup'), mk as (select event_id, user_id, case when event_id % 2 = 0 then user_id * 37 + {_place('user_id')} else 1 end as made from events where event_type = 'signup'),
f as (select l.*, {_u('l.cursor')} as c, w.a, w.b from l asof left join w on {_u('l.cursor')} >= w.a), j as (select f.*, mk.made from f asof left join mk on f.user_id = mk.user_id and f.event_id > mk.event_id)
select event_id, coalesce(c <= b, false) as from_table, case when c <= b then length = b - a end as sound_bound, case when c <= b then case when made is null then case when not is_kernel then 'missing' end when made = cursor then 'matching' else 'different' end end as made from j""")
def table_loads(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    place, key = _placed(F.col("user_id") * 37, "user_id"), F.col("event_id")
    loads = e.where("event_type <> 'signup'").select("event_id", "user_id", F.lit(1).alias("reg"), place.alias("cursor"), F.when(key % 4 == 0, 900).otherwise(key % 1000).alias("length"), (key % 5 == 0).alias("is_kernel"))
    made = e.where("event_type = 'signup'").select("event_id", "user_id", F.lit(1).alias("reg"), F.when(key % 2 == 0, place).otherwise(1).alias("cursor"))
    return verify.table_load_check(loads, _tables(spark, sf), made, ["user_id"], "event_id").select("event_id", "from_table", "sound_bound", "made")


@_add("select user_id * 16 + k as addr, arg_max(pc, idx) as pc, count(*) as n from t where opcode = 'cld' group by user_id * 16 + k")
def thread_local_reads(spark, sf):
    reads = trace_of(spark, sf).select("idx", "pc", F.when(F.col("opcode") == "cld", "chwr_userlocal").otherwise("other").alias("hw"), (F.col("user_id") * 16).alias("base"), F.col("k").alias("offset"))
    return verify.thread_local_reads(reads)


@_add("""with h as (select r0 - 64 as n, k from (select r0, k, row_number() over (partition by r0 order by idx desc) as i from t where idx <= 500) where i = 1), g as (select unnest(range(1, 32)) as n)
select cast(g.n as integer) as reg_num, '[' || case when h.k is null then 0 else 1 end || '] $' || g.n || ' = ' || printf('%x', coalesce(h.k, 0)) as line from g left join h using (n)""")
def register_dump(spark, sf):
    rows = trace_of(spark, sf).select("idx", (F.col("k") % 32).cast("int").alias("reg_num"), F.col("k").alias("gpr_val"), F.lit(None).cast(trace.CAP).alias("cap"))
    return trace.dump_registers(rows, 500).where("reg_num < 32")


_ROOMS = """ac as (select l_orderkey as vid, cast(floor(l_extendedprice) as bigint) as addr, l_linenumber % 3 = 0 as cap from lineitem), ev as (select vid, min(addr) as lo, max(addr) as hi from ac group by 1),
wd as (select vid, lo, hi, case when bool_or(cap and addr = hi) then 32 when bool_or(addr = hi - 8) then 8 when bool_or(addr = hi - 4) then 4 when bool_or(addr = hi - 1) then 1 else 8 end as width from ac join ev using (vid) group by all),
rooms as (select vid, lo + greatest(0, 200000 + cast(floor(o_totalprice) as bigint) - (hi + width)) as total from wd join orders on o_orderkey = vid), bins as (select *, case when total <= 0 then 0 else cast(floor(log2(total)) as integer) + 1 end as bin from rooms)"""


def _rooms(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("l_linenumber") % 3 == 0, S.EVENTS["deref_load"] | S.EVENTS["deref_is_cap"]).otherwise(S.EVENTS["deref_load"])
    events = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("vid"), F.floor("l_extendedprice").cast("bigint").alias("addr"), kind.alias("type"))
    vertices = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("vid"), F.lit(0).cast("bigint").alias("base"), (F.floor("o_totalprice").cast("bigint") + 200000).alias("length"))
    return distribution.headroom(vertices, events)


@_add(f"with {_ROOMS} select bin, count(*) as n, min(total) as least, max(total) as most from bins group by bin")
def headroom_buckets(spark, sf):
    return distribution.bucket_counts(_rooms(spark, sf))


@_add(f"""with {_ROOMS}, s as (select vid, (select min(cc.vid) from cc where v.t_alloc >= cc.time and (cc.t_return is null or v.t_alloc <= cc.t_return)) as call, t_alloc from v)
select s.vid, total, case when cc.t_return is not null then cc.address end as address, t_alloc from s join cc on cc.vid = s.call join bins b on b.vid = s.vid and b.bin = 18""")
def headroom_functions(spark, sf):
    g = calls_of(spark, sf)
    made = G.call_at(g.vertices, g).join(g.vertices.select("vid", "t_alloc"), "vid")
    return distribution.bucket_functions(_rooms(spark, sf), made, 18)


@_add("select place as at, min(label) as label from (select 'x' || user_id as place, opcode as label from t union all select 'x' || k, 'except ' || exception from t union all select 'y' || idx, 'at ' || pc from t) group by 1")
def labels_united(spark, sf):
    t = trace_of(spark, sf)
    rows = lambda p, key, label: t.select(F.concat(F.lit(p), F.col(key).cast("string")).alias("at"), label.alias("label"))
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return distribution.united_labels(rows("x", "user_id", F.col("opcode")), rows("x", "k", text("except ", "exception")), rows("y", "idx", text("at ", "pc")))


@_add("with p as (select idx, user_id, case when opcode in ('cjalr', 'syscall') then 1 when opcode in ('cjr', 'eret') then -1 end as step from t where opcode in ('cjalr', 'cjr', 'syscall', 'eret')) select count(*) as calls from p where step = 1")
def calls_in_trace(spark, sf):
    rows = trace_of(spark, sf).withColumn("exception", F.lit(31)).select("*", F.lit(0).alias("asid"), F.lit(0).alias("hwthread"), F.lit(None).cast("int").alias("reg_num"), F.lit(None).cast("bigint").alias("gpr_val"), F.lit(None).cast(trace.CAP).alias("cap"))
    frames = trace.call_graph(trace.call_events(rows))
    return frames.where("op <> 0").agg(F.count("*").alias("calls"))


#: Orders call, and their lines call within them; every 400th order doesn't return, so what follows is called by it.
_EVENTS = """ln as (select distinct l_orderkey, l_linenumber from lineitem where l_linenumber < 10),
fr as (select o_orderkey * 100 as call, 1 as op, o_custkey * 16 as address, case when o_orderkey % 400 <> 0 then o_orderkey * 100 + 99 end as closed, o_orderkey, 0 as nested from orders
 union all select l_orderkey * 100 + l_linenumber * 9, 1, l_linenumber * 8, l_orderkey * 100 + l_linenumber * 9 + 4, l_orderkey, 1 from ln join orders on o_orderkey = l_orderkey),
up as (select *, last_value(case when nested = 0 and closed is null then call end ignore nulls) over (order by call rows between unbounded preceding and 1 preceding) as stuck, count(case when nested = 0 and closed is null then 1 end) over (order by call rows between unbounded preceding and 1 preceding) as below from fr),
frames as (select call, case when nested = 1 then o_orderkey * 100 else coalesce(stuck, -1) end as parent, op, address, closed, cast(1 + below + case when nested = 1 and o_orderkey % 400 <> 0 then 1 else 0 end as integer) as depth from up)"""


def call_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of `trace.call_events` that orders and their lines make."""
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey")
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_linenumber < 10").select("l_orderkey", "l_linenumber").distinct().join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    none = F.lit(None).cast("bigint")
    row = lambda idx, kind, target, expected: F.struct(idx.alias("idx"), F.lit(kind).alias("kind"), target.cast("bigint").alias("target"), expected.alias("expected"))
    at, inner = F.col("o_orderkey") * 100, F.col("l_orderkey") * 100 + F.col("l_linenumber") * 9
    outer = F.array(row(at, "call", F.col("o_custkey") * 16, at + 1), row(at + 99, "return", at + F.when(F.col("o_orderkey") % 400 == 0, 2).otherwise(1), none))
    within = F.array(row(inner, "call", F.col("l_linenumber") * 8, inner + 1), row(inner + 4, "return", inner + 1, none))
    rows = orders.select(F.explode(outer).alias("e")).unionByName(lines.select(F.explode(within).alias("e"))).select("e.*")
    return rows.select("idx", (F.col("idx") * 2).alias("time"), "kind", (F.col("idx") * 4).alias("pc"), "target", "expected", F.lit(False).alias("raised"))


@_add(f"with {_EVENTS} select call, parent, op, address, closed, depth from frames union all select -1, null, 0, null, null, 0")
def call_frames(spark, sf):
    return trace.call_graph(call_rows(spark, sf)).select("call", "parent", "op", "address", "closed", "depth")


@_add(f"with {_EVENTS} select cast(row_number() over (order by call desc) as integer) as backtrace, call * 4 as pc, address as target from frames where call <= 300000 and (closed is null or closed > 300000)")
def open_calls(spark, sf):
    return trace.backtrace(call_rows(spark, sf), 300_000)
