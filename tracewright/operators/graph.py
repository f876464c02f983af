"""The provenance and call graph as tables, and its masks, annotations and rewrites.

Vertices of both layers have ids from one range.  A mask leaves vertices out and
an annotation adds a column `annotated_*`; both are functions from graph to graph,
so a chain of them is one lazy plan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import closure, lookup
from .scan import running

# Edge operations, system calls, allocators.
CALL, SYSCALL, CALL_TARGET, VISIBLE, RETURN = 1, 2, 3, 4, 5
EXECVE, MMAP = 59, 477
ALLOCATORS = ("malloc", "calloc", "realloc", "mallocx", "rallocx", "aligned_alloc", "posix_memalign", "reallocf")
RETURN_REGISTER, STACK_REGISTER = 3, 11

VERTEX = "vid long, origin string, pc long, is_kernel boolean, base long, offset long, length long, perms int, otype int, valid boolean, sealed boolean, t_alloc long, t_free long"
EVENT = "vid long, time long, addr long, type int"
CALL_VERTEX = "vid long, address long, symbol string, symbol_file string, t_return long, addr_return long, frame_base long, frame_size long"
EDGE = "eid long, src long, dst long, op int, time long, addr long, regs array<int>"


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    events: DataFrame
    calls: DataFrame
    edges: DataFrame
    name: str = ""

    def transform(self, *steps: Callable[[Graph], Graph]) -> Graph:
        out = self
        for step in steps:
            out = step(out)
        return out

    def mask(self, hidden: Column) -> Graph:
        """Without the pointers for which `hidden` is true."""
        return replace(self, vertices=self.vertices.where(~F.coalesce(hidden, F.lit(False))))

    def annotate(self, name: str, marked: DataFrame) -> Graph:
        """A boolean column: whether the vertex is among `marked(vid)`."""
        ids = marked.select("vid").distinct().withColumn(f"annotated_{name}", F.lit(True))
        joined = self.vertices.drop(f"annotated_{name}").join(ids, "vid", "left")
        return replace(self, vertices=joined.withColumn(f"annotated_{name}", F.coalesce(f"annotated_{name}", F.lit(False))))

    def derivations(self) -> DataFrame:
        """The edges between pointers."""
        return self.edges.where("op = 0")

    def purge(self) -> Graph:
        """Drop what hangs on hidden vertices: their events and edges."""
        held = self.vertices.select("vid").unionByName(self.calls.select("vid"))
        edges = self.edges.join(held.withColumnRenamed("vid", "src"), "src", "left_semi").join(held.withColumnRenamed("vid", "dst"), "dst", "left_semi")
        return replace(self, events=self.events.join(self.vertices.select("vid"), "vid", "left_semi"), edges=edges.select(*self.edges.columns))


Step = Callable[[Graph], Graph]


def chain(*steps: Step) -> Step:
    return lambda g: g.transform(*steps)


def _top() -> Column:
    """The end of a pointer's bounds, modulo 2^64."""
    return S.end_of(F.col("base"), F.col("length"))


def _within(begin: int | Column, end: int | Column) -> Column:
    """Whether a pointer's bounds lie in [begin, end]; addresses are unsigned."""
    limits = [F.lit(x).cast("long") if isinstance(x, int) else x for x in (begin, end)]
    return S.starts_from(F.col("base"), limits[0]) & S.ends_by(F.col("base"), F.col("length"), limits[1])


# --- masks
def without_null(g: Graph) -> Graph:
    return g.mask(((F.col("length") == 0) & (F.col("base") == 0)) | ~F.col("valid"))


def without_kernel(g: Graph) -> Graph:
    return g.mask((F.col("pc") != 0) & F.col("is_kernel"))


def without_origin(*origins: str) -> Step:
    return lambda g: g.mask(F.col("origin").isin(*origins))


without_fromptr, without_andperm, without_roots = without_origin("FROMPTR"), without_origin("ANDPERM"), without_origin("ROOT", "INITIAL_ROOT")


def without_stack(begin: int, end: int) -> Step:
    return lambda g: g.mask(_within(begin, end))


def without_before_execve(time: int) -> Step:
    """Pointers made, and calls with an edge of a time, before it."""

    def step(g: Graph) -> Graph:
        early = g.edges.where(F.col("op").isin(CALL, SYSCALL) & (F.col("time") < time))
        ends = early.select(F.col("src").alias("vid")).unionByName(early.select(F.col("dst").alias("vid"))).distinct()
        return replace(g.mask(F.col("t_alloc") < time), calls=g.calls.join(ends, "vid", "left_anti"))

    return step


def without_unused_kernel(g: Graph) -> Graph:
    return g.mask(F.col("is_kernel") & ~F.col("annotated_korigin") & ~F.col("annotated_ksyscall"))


def time_slice(start: int, end: int, creation: bool = True, deref: bool = False, access: bool = False) -> Step:
    """Pointers made, dereferenced or moved through memory in [start, end]; the call layer is hidden."""

    def step(g: Graph) -> Graph:
        kinds = (S.EVENTS["deref_load"] | S.EVENTS["deref_store"] | S.EVENTS["deref_call"]) * deref | (S.EVENTS["load"] | S.EVENTS["store"] | S.EVENTS["delete"]) * access
        hit = g.events.where(F.col("time").between(start, end) & S.has_any(F.col("type"), kinds)).select("vid").distinct().withColumn("_hit", F.lit(True))
        joined = g.vertices.join(hit, "vid", "left")
        made = F.col("t_alloc").between(start, end) if creation else F.lit(False)
        return replace(g, vertices=joined.where(made | F.coalesce("_hit", F.lit(False))).drop("_hit"), calls=g.calls.limit(0))

    return step


# --- annotations
def below(g: Graph, seeds: DataFrame) -> DataFrame:
    """The seeds and all pointers derived from them (a pointer has one parent)."""
    return closure.nearest_marked(_parents(g), seeds.select("vid", F.lit(True).alias("mark"))).select("vid")


def _parents(g: Graph) -> DataFrame:
    return g.derivations().select(F.col("dst").alias("vid"), F.col("src").alias("parent"))


def stack_pointers(seed: DataFrame) -> Step:
    return lambda g: g.annotate("stack", below(g, seed))


def touches_stack(begin: int, end: int) -> Step:
    deref = S.EVENTS["deref_load"] | S.EVENTS["deref_store"]
    return lambda g: g.annotate("stack_all", g.events.where(S.has_any(F.col("type"), deref) & F.col("addr").between(begin, end)))


def in_bounds(name: str, begin: int, end: int) -> Step:
    return lambda g: g.annotate(name, g.vertices.where(_within(begin, end)))


def guessed_stack_root(g: Graph, execve_time: int, low: int = 0x7FFF000000, high: int = 0x8000000000, least: int = 0x80000) -> DataFrame:
    """The last pointer with a stack's bounds that was made after the execve and has no such ancestor."""
    like = g.vertices.where((F.col("base") >= low) & (F.col("base") < high) & (F.col("length") >= least) & (F.col("t_alloc") >= execve_time)).select("vid", "t_alloc")
    # the nearest marked ancestor of each, one doubling for all: a marked vertex looks from its parent on
    up = _parents(g)
    above = closure.nearest_marked(up, like.select("vid", F.lit(True).alias("mark"))).select(F.col("vid").alias("parent"))
    deeper = like.select("vid").join(up, "vid").join(above, "parent", "left_semi").select("vid")
    return like.join(deeper, "vid", "left_anti").orderBy(F.desc("t_alloc"), F.desc("vid")).limit(1).select("vid")


def returned_by(g: Graph, calls: DataFrame, register: int = RETURN_REGISTER) -> DataFrame:
    """(vid, call): pointers that those calls return in the register."""
    edges = g.edges.where((F.col("op") == RETURN) & F.array_contains("regs", register)).select(F.col("src").alias("vid"), F.col("dst").alias("call"))
    return edges.join(calls.select(F.col("vid").alias("call")), "call", "left_semi").select("vid", "call")


def malloc_pointers(g: Graph) -> Graph:
    return g.annotate("malloc", below(g, returned_by(g, g.calls.where(F.col("symbol").isin(*ALLOCATORS)))))


def system_calls(g: Graph, code: int) -> DataFrame:
    """(vid, time) of the calls of that code."""
    made = g.edges.where(F.col("op") == SYSCALL).groupBy(F.col("dst").alias("vid")).agg(F.min("time").alias("time"))
    return g.calls.where(F.col("address") == code).join(made, "vid").select("vid", "time", "t_return")


def mmap_sources(code: int = MMAP) -> Step:
    """A column annotated_mmap: the mmap call whose result the pointer is derived from, nearest first, else -1."""

    def step(g: Graph) -> Graph:
        seeds = returned_by(g, system_calls(g, code))
        reached = closure.nearest_marked(_parents(g), seeds.withColumnRenamed("call", "mark")).withColumnRenamed("mark", "annotated_mmap")
        return replace(g, vertices=g.vertices.drop("annotated_mmap").join(reached, "vid", "left").withColumn("annotated_mmap", F.coalesce("annotated_mmap", F.lit(-1))))

    return step


def executable(g: Graph) -> Graph:
    return replace(g, vertices=g.vertices.withColumn("annotated_exec", S.has_any(F.col("perms"), S.PERMISSIONS["exec"])))


def last_execve(g: Graph) -> DataFrame:
    """One row: the latest execve (vid, time, t_return) and the pointer it returns as stack."""
    last = system_calls(g, EXECVE).orderBy(F.desc("t_return"), F.desc("time")).limit(1)
    stack = returned_by(g, last, STACK_REGISTER).select(F.col("vid").alias("stack"), F.col("call").alias("vid"))
    return last.join(stack, "vid", "left")


def kernel_pointers(g: Graph, after: int = 0, registers: int = 34) -> Graph:
    """Marks kernel pointers visible in low registers at a system call's return, but not at its entry."""
    calls = g.edges.where((F.col("op") == SYSCALL) & (F.col("time") >= after)).select(F.col("dst").alias("call"))
    low = F.exists("regs", lambda r: r < registers)
    seen = lambda op: g.edges.where((F.col("op") == op) & low).select(F.col("src").alias("vid"), F.col("dst").alias("call")).join(calls, "call", "left_semi")
    return g.annotate("ksyscall", seen(RETURN).join(seen(VISIBLE), ["vid", "call"], "left_anti"))


def first_moves(events: DataFrame) -> DataFrame:
    """(vid, type, time): the first load or store of each pointer itself; of both at one time, the store."""
    moves = events.where(S.has_any(F.col("type"), S.EVENTS["load"] | S.EVENTS["store"]))
    return moves.groupBy("vid").agg(F.min_by("type", F.struct("time", S.has_any(F.col("type"), S.EVENTS["load"]), "type")).alias("type"), F.min("time").alias("time"))


def first_used_by_user(g: Graph, after: int = 0) -> Graph:
    """Marks kernel pointers whose first memory event by user code after the time is a load."""
    first = first_moves(g.events.where(S.has_any(F.col("type"), S.EVENTS["usr"]) & (F.col("time") >= after))).where(S.has_any(F.col("type"), S.EVENTS["load"]))
    return g.annotate("korigin", first.join(g.vertices.where("is_kernel").select("vid"), "vid", "left_semi"))


def relocations(targets: DataFrame) -> Step:
    """Marks pointers stored at relocation targets, and those that stores or capabilities go through there."""

    def step(g: Graph) -> Graph:
        at = g.events.join(targets.select(F.col("target").alias("addr")), "addr", "left_semi")
        through = S.EVENTS["deref_store"] | S.EVENTS["deref_is_cap"]
        return g.annotate("capreloc", at.where(S.has_any(F.col("type"), S.EVENTS["store"]))).annotate("capreloc_ptr", at.where(S.has_any(F.col("type"), through)))

    return step


def global_pointers(tables: DataFrame) -> Step:
    """Marks pointers loaded from capability tables (ends included), pointers to tables, and what is derived from the first."""

    def step(g: Graph) -> Graph:
        from .verify import in_some_range

        ranges = tables.select("start", "end")
        loads = g.events.where(S.has_any(F.col("type"), S.EVENTS["load"])).select("vid", "addr")
        loaded = in_some_range(loads, ranges, "addr", "_in").where("_in").select("vid").distinct()
        # of the tables that begin before a pointer, the one that reaches furthest
        key = lambda c: S.sort_key(F.col(c).cast("long"))
        spans = running(ranges.select(key("start").alias("_s"), key("end").alias("_e")).where("_s <= _e"), [], ["_s"], _reach=("max", F.col("_e")))
        bounded = lookup.floor_lookup(g.vertices.select("vid", "base", "length", key("base").alias("_b")), spans, "_b", "_s", ["_reach"], float(1 << 12))
        table = bounded.where(S.ends_by(F.col("base"), F.col("length"), S.sort_key(F.col("_reach")))).select("vid").distinct()
        return g.annotate("globptr", loaded).annotate("captblptr", table).annotate("globderived", below(g, loaded).join(loaded, "vid", "left_anti"))

    return step


def call_symbols(symbols: DataFrame) -> Step:
    """The symbols of called addresses."""

    def step(g: Graph) -> Graph:
        s = symbols.groupBy(F.col("addr").alias("address")).agg(F.min(F.struct("name", "file")).alias("_s"))
        targets = g.edges.where(F.col("op") == CALL).select(F.col("dst").alias("vid")).distinct().withColumn("_called", F.lit(True))
        joined = g.calls.join(targets, "vid", "left").join(s, "address", "left")
        pick = lambda c, f: F.when(F.col("_called") & F.col("_s").isNotNull(), F.col(f"_s.{f}")).otherwise(F.col(c)).alias(c)
        return replace(g, calls=joined.select(*[pick(c, {"symbol": "name", "symbol_file": "file"}[c]) if c in ("symbol", "symbol_file") else c for c in g.calls.columns]))

    return step


def fuse_bounds(g: Graph) -> Graph:
    """FROMPTR and the SETBOUNDS derived from it become one PTR_SETBOUNDS pointer.

    It has the child's id, pc and capability, the events and edges of both, and the
    later end, or none where either is open.
    """
    v = g.vertices
    parents = v.where("origin = 'FROMPTR'").select(F.col("vid").alias("_parent"), F.col("t_alloc").alias("_alloc"), F.col("t_free").alias("_free"))
    links = g.derivations().select(F.col("src").alias("_parent"), F.col("dst").alias("vid"))
    pairs = v.where("origin = 'SETBOUNDS'").select("vid").join(links, "vid").join(parents, "_parent")
    joined = v.join(pairs, "vid", "left").join(pairs.select(F.col("_parent").alias("vid")).distinct(), "vid", "left_anti")
    fused = F.col("_parent").isNotNull()
    rows = joined.withColumn("origin", F.when(fused, "PTR_SETBOUNDS").otherwise(F.col("origin"))).withColumn("t_free", F.when(fused & ((F.col("t_free") < 0) | (F.col("_free") < 0)), -1).when(fused, F.greatest("t_free", "_free")).otherwise(F.col("t_free")))
    rows = rows.withColumn("t_alloc", F.when(fused, F.col("_alloc")).otherwise(F.col("t_alloc"))).select(*v.columns)
    remap = pairs.select(F.col("_parent").alias("_old"), F.col("vid").alias("_new"))

    def moved(df: DataFrame, column: str) -> DataFrame:
        return df.join(remap, df[column] == remap["_old"], "left").withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")

    edges = moved(moved(g.edges, "src"), "dst").where("not (op = 0 and src = dst)").select(*g.edges.columns)
    return replace(g, vertices=rows, events=moved(g.events, "vid").select(*g.events.columns), edges=edges)


def user_process_chain(stack: tuple[int, int], tables: DataFrame, targets: DataFrame, symbols: DataFrame, execve_time: int) -> Step:
    """The preprocessing of one user process, in its fixed order."""
    return chain(
        call_symbols(symbols), lambda g: kernel_pointers(g, execve_time), lambda g: first_used_by_user(g, execve_time), without_before_execve(execve_time), without_null, fuse_bounds,
        without_unused_kernel, touches_stack(*stack), lambda g: stack_pointers(guessed_stack_root(g, execve_time))(g), malloc_pointers, executable, relocations(targets), global_pointers(tables),
    )


def filters(execve: int | None = None, null: bool = False, roots: bool = False, fuse: bool = False, fromptr: bool = False, andperm: bool = False, stack: tuple[int, int] | None = None, kernel: bool = False,
            times: tuple[int, int] | None = None, by: tuple[str, ...] = ("creation",), mark_stack: tuple[int, int] | None = None, mark_mmap: bool = False, mark_malloc: bool = False, mark_exec: bool = False) -> Step:
    """The masks and annotations that are asked for, in their fixed order whatever the order of the options."""
    steps: list[Step] = []
    if execve is not None:
        steps.append(without_before_execve(execve))
    steps += [f for wanted, f in ((null, without_null), (roots, without_roots), (fuse, fuse_bounds), (fromptr, without_fromptr), (andperm, without_andperm)) if wanted]
    if stack:
        steps.append(without_stack(*stack))
    if kernel:
        steps.append(without_kernel)
    if times:
        steps.append(time_slice(*times, **{k: k in by for k in ("creation", "deref", "access")}))
    if mark_stack:
        inside = in_bounds("stack_seed", *mark_stack)
        steps += [lambda g: stack_pointers(inside(g).vertices.where("annotated_stack_seed").select("vid"))(g), touches_stack(*mark_stack)]
    steps += [f for wanted, f in ((mark_mmap, mmap_sources()), (mark_malloc, malloc_pointers), (mark_exec, executable)) if wanted]
    return chain(*steps)


def active_memory(events: DataFrame) -> DataFrame:
    """(vid, addr, time): where pointers are stored at the end: the last of store and delete is a store."""
    kinds = S.EVENTS["store"] | S.EVENTS["delete"]
    last = events.where(S.has_any(F.col("type"), kinds)).groupBy("vid", "addr").agg(F.max_by(F.struct("time", "type"), F.struct("time", "type")).alias("e"))
    return last.where(S.has_any(F.col("e.type"), S.EVENTS["store"])).select("vid", "addr", "e.time")


# --- numbers and dumps
def event_summary(events: DataFrame, key: str = "vid") -> DataFrame:
    """(key, flags, derefs, deref_loads, deref_stores, stored): all kinds of a pointer's events, how often it was dereferenced, and at how many addresses it was stored."""
    t = F.col("type")
    count = lambda *kinds: F.count_if(S.has_any(t, sum(S.EVENTS[k] for k in kinds)))
    return events.groupBy(key).agg(
        F.bit_or("type").alias("flags"), count("deref_load", "deref_store").alias("derefs"), count("deref_load").alias("deref_loads"), count("deref_store").alias("deref_stores"),
        F.count_distinct(F.when(S.has_any(t, S.EVENTS["store"]), F.col("addr"))).alias("stored"),
    )


def statistics(g: Graph, stack: tuple[int, int] | None = None) -> DataFrame:
    """One row: dereferences, stored addresses, readers of the argument area, set-bounds pointers, and those in the stack, malloc and mmap results."""
    e, v = g.events, g.vertices
    zero = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    sums = event_summary(e).agg(zero("deref_loads", "deref_loads"), zero("deref_stores", "deref_stores"), zero("stored", "stored_addresses"))
    area = e.where(S.has_any(F.col("type"), 4)).join(v.select("vid", "base", "offset", "length"), "vid").where(F.col("addr").between(F.col("base") + F.col("offset"), _top()))
    readers = area.agg(F.count_distinct("vid").alias("argument_readers"))
    inside = _within(*stack) if stack else F.lit(False)
    bounds = v.where(F.col("origin").isin("SETBOUNDS", "PTR_SETBOUNDS")).agg(F.count("*").alias("set_bounds"), F.count_if(inside).alias("stack_bounds"))
    mallocs = returned_by(g, g.calls.where(F.col("symbol").isin(*ALLOCATORS))).agg(F.count("*").alias("mallocs"))
    mmaps = returned_by(g, system_calls(g, MMAP)).agg(F.count("*").alias("mmaps"))
    out = sums
    for part in (readers, bounds, mallocs, mmaps):  # one row each
        out = out.join(F.broadcast(part), F.lit(True))
    return out


def orphans_bound(vertices: DataFrame) -> DataFrame:
    """One capability that holds all of the given ones."""
    return vertices.agg(F.min("base").alias("base"), F.max(S.bound(F.col("base"), F.col("length"))).alias("top"), F.bit_or("perms").alias("perms"), F.any_value("otype").alias("otype"))


def call_counts(g: Graph) -> DataFrame:
    """(src, dst, calls, times): how often and when each caller called each callee, by address."""
    name = lambda a: g.calls.select(F.col("vid").alias(a), F.col("address").alias(f"{a}_address"))
    edges = g.edges.where(F.col("op").isin(CALL, SYSCALL)).join(name("src"), "src").join(name("dst"), "dst")
    return edges.groupBy(F.col("src_address").alias("src"), F.col("dst_address").alias("dst")).agg(F.count("*").alias("calls"), F.sort_array(F.collect_list("time")).alias("times"))


def address_map(g: Graph) -> DataFrame:
    """(vid, start, end, time, colour): a segment per pointer."""
    return g.vertices.select("vid", F.col("base").alias("start"), _top().alias("end"), F.col("t_alloc").alias("time"), F.col("perms").bitwiseAND(14).alias("colour"))


def deref_map(g: Graph, exact: bool = False) -> DataFrame:
    """(vid, start, end, time, kind): the pointer's bounds at each dereference."""
    t = F.col("type")
    is_load, is_store = (t == 4, t == 8) if exact else (S.has_any(t, 4), S.has_any(t, 8))
    hits = g.events.select("vid", "time", F.when(is_load, "load").when(is_store, "store").alias("kind")).where("kind is not null")
    return hits.join(g.vertices.select("vid", F.col("base").alias("start"), _top().alias("end")), "vid").select("vid", "start", "end", "time", "kind")


def access_map(g: Graph) -> DataFrame:
    """(vid, addr, time, kind): where pointers themselves are loaded and stored."""
    t = F.col("type")
    return g.events.select("vid", "addr", "time", F.when(S.has_any(t, 1), "load").when(S.has_any(t, 2), "store").alias("kind")).where("kind is not null")


def memory_bands(vmmap: DataFrame) -> DataFrame:
    """(start, end, label): the mapped ranges with their permissions and file."""
    path = F.when(F.trim("path") != "", S.basename(F.col("path"))).when(F.contains("flag", F.lit("D")), "stack").otherwise("")
    return vmmap.select("start", "end", F.trim(F.concat(F.lit("("), F.col("perm"), F.lit(") "), path)).alias("label"))


def view_box(segments: DataFrame, columns: list[str]) -> DataFrame:
    return segments.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])


def call_at(vertices: DataFrame, g: Graph) -> DataFrame:
    """(vid, call, address): the first call, by id, during which a pointer was made; a call without a return holds on, and gives neither."""
    began = g.edges.where(F.col("op").isin(CALL, SYSCALL)).groupBy(F.col("dst").alias("call")).agg(F.min("time").alias("t_call"))
    spans = g.calls.select(F.col("vid").alias("call"), "address", "t_return").join(began, "call")
    spans = spans.withColumn("_until", F.coalesce("t_return", F.lit((1 << 63) - 1))).withColumn("_call", F.col("call"))
    first = lookup.first_covering(vertices.select("vid", "t_alloc"), spans, "t_alloc", "t_call", "_until", "call", ["_call", "address", "t_return"]).where("_call is not null")
    return first.select("vid", F.when(F.col("t_return").isNotNull(), F.col("_call")).alias("call"), F.when(F.col("t_return").isNotNull(), F.col("address")).alias("address"))


def dump_vertices(g: Graph) -> DataFrame:
    """(vid, line): a line of text for each pointer, with true counts of its events and its annotations."""
    t = F.col("type")
    counts = g.events.groupBy("vid").agg(*[F.count_if(S.has_any(t, S.EVENTS[k])).alias(f"n_{k}") for k in ("load", "store", "deref_load", "deref_store")])
    marks = F.array_join(F.filter(F.array(*[F.when(F.col(c).cast("string").isin("true"), F.lit(c.removeprefix("annotated_"))) for c in g.vertices.columns if c.startswith("annotated_")] or [F.lit(None).cast("string")]), lambda x: x.isNotNull()), ",")
    v = g.vertices.join(counts, "vid", "left")
    cap = S.capability_text(F.col("base"), F.col("offset"), F.col("length"), F.col("perms"), F.col("otype"), F.col("valid"), F.col("sealed"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return v.select("vid", F.format_string("%s pc:%s %s t:[%d,%d] {%s} load:%d store:%d deref:%d/%d", F.col("origin"), S.hex_text(F.col("pc")), cap, F.col("t_alloc"), F.col("t_free"), marks, n("n_load"), n("n_store"), n("n_deref_load"), n("n_deref_store")).alias("line"))



def dump_calls(g: Graph) -> DataFrame:
    """(vid, line): a line of text for each call: what is called, from where and when, and what it returned to."""
    made = g.edges.where(F.col("op").isin(CALL, SYSCALL)).groupBy(F.col("dst").alias("vid")).agg(F.min(F.struct("time", "src", "op", "addr")).alias("_m"))
    symbol = F.coalesce(F.concat(F.lit(" "), F.col("symbol"), F.coalesce(F.concat(F.lit(" ("), F.col("symbol_file"), F.lit(")")), F.lit(""))), F.lit(""))
    kind = F.when(F.col("_m.op") == SYSCALL, "syscall").when(F.col("_m.op") == CALL, "call").otherwise("root")
    moment = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    by = F.coalesce(F.concat(F.lit(" by "), F.col("_m.src").cast("string")), F.lit(""))
    return g.calls.join(made, "vid", "left").select("vid", F.concat(kind, F.lit(" "), S.hex_text(F.coalesce("address", F.lit(0))), symbol, by, F.lit(" t:["), moment("_m.time"), F.lit(","), moment("t_return"), F.lit("]")).alias("line"))


def dump_events(g: Graph) -> DataFrame:
    """(vid, time, line): a line of text for each event of a pointer, with the names of its kinds."""
    names = F.array_join(F.filter(F.array(*[F.when(S.has_any(F.col("type"), bit), F.lit(n)) for n, bit in S.EVENTS.items()]), lambda x: x.isNotNull()), "|")
    return g.events.select("vid", "time", F.concat(F.lit("  "), F.col("time").cast("string"), F.lit(" "), S.hex_text(F.col("addr")), F.lit(" "), names).alias("line"))


def dump(g: Graph, pointers: Column | None = None, called: Column | None = None, events: bool = False, layers: tuple[str, ...] = ("prov", "call")) -> DataFrame:
    """(layer, vid, place, line) of the graph as text: the pointers and the calls that meet the conditions, each pointer's events below it.  Ordered by layer, vid and place it reads as one text."""
    kept = g if pointers is None else replace(g, vertices=g.vertices.where(pointers))
    parts = []
    if "prov" in layers:
        parts.append(dump_vertices(kept).select(F.lit("prov").alias("layer"), "vid", F.lit(-1).cast("long").alias("place"), "line"))
        if events:
            own = replace(kept, events=kept.events.join(kept.vertices.select("vid"), "vid", "left_semi"))
            parts.append(dump_events(own).select(F.lit("prov").alias("layer"), "vid", F.col("time").alias("place"), "line"))
    if "call" in layers:
        parts.append(dump_calls(g if called is None else replace(g, calls=g.calls.where(called))).select(F.lit("call").alias("layer"), "vid", F.lit(-1).cast("long").alias("place"), "line"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
