"""Readers, small trace operators and callbacks, case by case."""

import json
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tracewright.functions import scalars as S
from tracewright.operators import graph as G
from tracewright.operators import lookup, trace, verify
from tracewright.operators.callbacks import Callback, Callbacks
from tracewright.sources import tables


def test_parts_of_a_trace(spark):
    t = spark.createDataFrame([(i, "cseal" if i == 6 else "nop") for i in range(10)], "idx long, opcode string")
    assert [r.idx for r in trace.scanned(t, 3, 6).collect()] == [3, 4, 5, 6]
    assert [r.idx for r in trace.scanned(t, end=2, backward=True).collect()] == [2, 1, 0]
    assert sorted(r.idx for r in trace.stopped(t, F.col("idx") % 4 == 3).collect()) == [0, 1, 2, 3]
    assert trace.stopped(t, F.col("idx") > 99).count() == 10
    assert [r.idx for r in trace.unsupported(t).collect()] == [6]
    parts = [spark.createDataFrame([(3, "c"), (1, "a")], "idx long, line string"), spark.createDataFrame([(2, "b")], "idx long, line string")]
    assert [r.line for r in trace.in_order(*parts).collect()] == ["a", "b", "c"]


def test_initial_stack(spark):
    cap = "struct<base:bigint,offset:bigint,length:bigint,perms:bigint,otype:bigint,valid:boolean,sealed:boolean>"
    value = lambda b: Row(base=b, offset=0, length=16, perms=1, otype=0, valid=True, sealed=False)
    rows = [(0, "li", 29, None, 77), (1, "x", 64 + 11, value(100), None), (2, "x", 64 + 11, value(200), None), (3, "x", 64 + 12, value(300), None), (4, "li", 29, None, 88), (5, "eret", None, None, None), (6, "x", 64 + 11, value(400), None), (7, "eret", None, None, None), (8, "li", 29, None, 99)]
    r = trace.initial_stack(spark.createDataFrame(rows, f"idx long, opcode string, reg_num int, cap {cap}, gpr_val long")).first()
    assert (r["cap"].base, r["sp"], r["at"]) == (200, 88, 5)


def trace_rows(spark, rows):
    """Trace rows from dicts; what a row doesn't say is null, or what a plain instruction has."""
    plain = dict(cycles=0, pc=4096, opcode="nop", ops=[], is_load=False, is_store=False, mem_addr=None, exception=31, asid=0, hwthread=0, reg_num=None, gpr_val=None, cap=None)
    names = [x.split()[0] for x in "idx cycles pc opcode ops is_load is_store mem_addr exception asid hwthread reg_num gpr_val cap".split()]
    return spark.createDataFrame([tuple(({"idx": i} | plain | r)[n] for n in names) for i, r in enumerate(rows)], trace.TRACE)


CAP = dict(base=4096, offset=0, length=64, perms=7, otype=0, valid=True, sealed=False)


def test_rows_that_cannot_be_decoded(spark):
    t = trace_rows(spark, [{}, {"pc": None}, {"opcode": " "}, {"reg_num": 200}, {"is_load": True}, {"is_load": True, "exception": 4}, {"ops": [(300, 0, 0)]}])
    assert [r.reject for r in trace.rejected(t).orderBy("idx").collect()] == [None, "no pc", "no opcode", "unknown register", "no address", None, "unknown register"]


def test_jumps_need_permission_to_execute(spark):
    t = trace_rows(spark, [{"reg_num": 65, "cap": CAP}, {"reg_num": 66, "cap": CAP | {"perms": 5}}, {"opcode": "cjr", "ops": [(65, 0, 0)]}, {"opcode": "cjr", "ops": [(66, 0, 0)]}, {"opcode": "cjalr", "ops": [(81, 0, 0), (66, 0, 0)], "reg_num": 81, "cap": CAP}])
    assert sorted(tuple(r) for r in trace.jumps_without_exec(t).collect()) == [(3, 4096, 66, 5), (4, 4096, 66, 5)]


def test_differences_of_two_traces(spark):
    nop = {"opcode": "lui", "ops": [(0, 0, 0), (0, 42, 0)]}
    one = trace_rows(spark, [{"pc": 4}, nop, {"pc": 8, "opcode": "ld", "mem_addr": 100, "gpr_val": 5}, {"pc": 12, "cap": CAP}, {"pc": 16, "opcode": "mfc0", "gpr_val": 1}, {"pc": 20}])
    two = trace_rows(spark, [{"pc": 4}, {"pc": 8, "opcode": "ld", "mem_addr": 104}, nop, nop, {"pc": 12, "cap": CAP | {"length": 65, "valid": False}}, {"pc": 16, "opcode": "mfc0", "gpr_val": 2}])
    got = {tuple(r)[1:] for r in trace.trace_differences(one, two).collect()}
    assert got == {(2, 1, "mem_addr", "100", "104"), (3, 4, "valid", "true", "false"), (3, 4, "length", "64", "65"), (5, None, "row", "5", None)}
    assert {r.field for r in trace.trace_differences(one, two, pc_only=True).collect()} == {"row"}
    assert trace.trace_differences(one, one).collect() == []


def test_backtrace_with_symbols(spark):
    rows = [(1, 1, "call", 100, 0x1010, 101, False), (5, 5, "call", 200, -4096 + 8, 201, False), (7, 7, "call", 300, 0x10, 301, False)]
    events = spark.createDataFrame(rows, "idx long, time long, kind string, pc long, target long, expected long, raised boolean")
    symbols = spark.createDataFrame([(0x1000, "main"), (0x1000, "other"), (-4096, "kernel")], "addr long, name string")
    assert [(r.target, r.symbol, r.offset) for r in trace.named_backtrace(events, 9, symbols).orderBy("backtrace").collect()] == [(0x10, None, None), (-4088, "kernel", 8), (0x1010, "main", 16)]


def test_missing_parents(spark):
    v, e = spark.createDataFrame([(1,), (2,)], "vid long"), spark.createDataFrame([(1, 2), (9, 1), (None, 1)], "src long, dst long")
    assert [tuple(r) for r in trace.missing_parents(v, e).collect()] == [(1, 9)]


def test_lookups_of_single_rows(spark):
    pairs = spark.createDataFrame([(1, 5, "e"), (1, 2, "b"), (2, 9, "i")], "k int, o int, v string")
    assert {tuple(r) for r in lookup.first_match(pairs, ["k"], ["o"], ["v"]).collect()} == {(1, "b"), (2, "i")}
    spans = spark.createDataFrame([(1, 100, 0, 10), (2, 130, 0, 10), (3, 104, 20, 30), (4, 103, 5, 6)], "i int, t long, a long, b long")
    assert [r.i for r in lookup.nearest_in_time(spans, 104, 6, 20, "t", "a", "b", "i").collect()] == [4]
    assert lookup.nearest_in_time(spans, 104, 40, 20, "t", "a", "b", "i").collect() == []
    assert {tuple(r) for r in verify.frequencies(spark.createDataFrame([(7,), (7,), (8,)], "addr long"), "addr").collect()} == {(7, 2), (8, 1)}
    tops = spark.range(1).select(S.round_top(F.lit(16), F.lit(33), F.lit(7)).alias("a"), S.round_top(F.lit(16), F.lit(32), F.lit(7)).alias("b")).first()
    assert tuple(tops) == (40, 32)


def test_memory_map_tables(spark, tmp_path):
    maps = spark.createDataFrame([(0, 0x1000, 0x2000, "r-x", "", "/lib/libc.so"), (1, 0x9000, 0xA000, "rw-", "D", ""), (2, 0x400, 0x800, "r--", "", "")], "ordinal int, start long, end long, perm string, flag string, path string")
    assert tables.heap_map(maps).first()["ordinal"] == 2
    assert sorted(r.label for r in G.memory_bands(maps).collect()) == ["(r--)", "(r-x) libc.so", "(rw-) stack"]
    (tmp_path / "text").write_text("one\ntwo\n\nthree\n")
    lines = tables.numbered_lines(spark, f"file://{tmp_path}/text").orderBy("line_no").collect()
    assert [r.value for r in lines] == ["one", "two", "", "three"] and len({r.line_no for r in lines}) == 4
    elf = spark.createDataFrame([("a", "/x/a", "captable", 0x5000, 64), ("a", "/x/a", "symbol", 0x10, 4)], "file string, path string, kind string, addr long, size long")
    assert [tuple(r) for r in tables.captables(elf).collect()] == [(0x5000, 0x5040, "/x/a")]


def test_readelf_symbols(spark):
    text = [
        "   Num:    Value          Size Type    Bind   Vis      Ndx Name",
        "     1: 0000000000001040    24 FUNC    GLOBAL DEFAULT   12 main",
        "     2: ffffffff80002000  0x40 OBJECT  LOCAL  DEFAULT    3 table",
        "     3: 0000000000000000     0 FUNC    GLOBAL DEFAULT  UND puts",
        "     4: 0000000000003000     0 NOTYPE  LOCAL  DEFAULT    1 label",
    ]
    got = tables.readelf_symbols(spark.createDataFrame([("a.out", x) for x in text], "objfile string, value string"))
    assert {tuple(r) for r in got.collect()} == {("a.out", "main", 0x1040, 24, "FUNC"), ("a.out", "table", -2147475456, 64, "OBJECT"), ("a.out", "label", 0x3000, 0, "NOTYPE")}


def test_globals_as_json_and_as_text(spark):
    functions = [{"name": "main", "lowpc": 0x100, "highpc": 0x140}, {"name": "start", "lowpc": 0x200, "highpc": 0}, {"name": "lost", "lowpc": 0x300, "highpc": 0}, {"name": "f(int, char *)", "lowpc": 0x400, "highpc": 0x408}]
    variables = [{"name": "buffer", "size": 64, "address": 0x800}, {"name": "ns::x", "size": 4, "address": 0x900}]
    docs = spark.createDataFrame([(json.dumps({"functions": functions, "variables": variables}),)], "value string")
    lines = [f"codesegment name:{f['name']}, lowpc: {f['lowpc']:#x}, highpc: {f['highpc']:#x}" for f in functions] + [f"variable name:{v['name']}, size:{v['size']}, at address {v['address']:#x}" for v in variables]
    symbols = spark.createDataFrame([(0x1200, 12), (0x1200, 8)], "addr long, size long")
    want = {("main", 0x1100, 64, "FUNC"), ("start", 0x1200, 12, "FUNC"), ("f(int, char *)", 0x1400, 8, "FUNC"), ("buffer", 0x1800, 64, "OBJECT"), ("ns::x", 0x1900, 4, "OBJECT")}
    assert {tuple(r) for r in tables.dwarf_globals(docs, symbols, base=0x1000).collect()} == want
    text = spark.createDataFrame([(x,) for x in [*lines, "variable name:gone, size:<unknown>", "anything else"]], "value string")
    assert {tuple(r) for r in tables.dwarf_globals_text(text, symbols, 0x1000).collect()} == want | {("gone", None, -1, "OBJECT")}


@pytest.fixture(scope="module")
def process(spark):
    """A user process: a stack pointer with one derived from it, a null, and an old one; a call that sees and returns them."""
    high = 0x7FFF000000
    v = [(1, "INITIAL_ROOT", 8, False, high, 0, 0x100000, 4, 50), (2, "SETBOUNDS", 8, False, high + 64, 0, 32, 4, 60), (3, "ROOT", 8, False, 0, 0, 0, 4, 70), (4, "ROOT", 8, False, 64, 0, 64, 2, 5), (5, "FROMPTR", 8, False, 4096, 0, 64, 6, 80), (6, "SETBOUNDS", 8, False, 4096, 0, 16, 6, 81)]
    vertices = spark.createDataFrame([(*r[:8], 0, True, False, r[8], -1) for r in v], G.VERTEX)
    events = spark.createDataFrame([(2, 61, high + 70, 4), (5, 82, 0x5000, 1), (6, 83, 0x6000, 2)], G.EVENT)
    calls = spark.createDataFrame([(100, 0x400, "plain", None, 90, None, 0, 0)], G.CALL_VERTEX)
    edge = [(0, 1, 2, 0, None, None, None), (1, 5, 6, 0, None, None, None), (2, 0, 100, G.CALL, 55, None, None), (3, 6, 100, G.RETURN, 90, None, [3])]
    return G.Graph(vertices, events, calls, spark.createDataFrame(edge, G.EDGE), "process"), high


def test_the_chain_of_a_user_process(spark, process):
    g, high = process
    assert [r.vid for r in G.guessed_stack_root(g, 40).collect()] == [1]
    captables = spark.createDataFrame([(0x5000, 0x5100)], "start long, end long")
    targets = spark.createDataFrame([(0x6000,)], "target long")
    symbols = spark.createDataFrame([(0x400, "malloc", "libc.so")], "addr long, name string, file string")
    out = G.user_process_chain((high, high + 0x100000), captables, targets, symbols, 40)(g)
    rows = {r.vid: r for r in out.vertices.collect()}
    # made before the execve, null, and the one that its bounds were fused with are gone
    assert set(rows) == {1, 2, 6} and rows[6].origin == "PTR_SETBOUNDS"
    marks = lambda vid: {c.removeprefix("annotated_") for c in out.vertices.columns if c.startswith("annotated_") and rows[vid][c]}
    assert marks(1) == {"stack"} and marks(2) == {"stack", "stack_all"} and marks(6) == {"malloc", "exec", "capreloc", "globptr"}
    assert [r.symbol for r in out.calls.collect()] == ["malloc"]


def test_saved_graphs_are_read_once(spark, process, tmp_path):
    tables.save_graph(process[0], f"file://{tmp_path}/g.parquet")
    held = tables.Graphs(spark)
    g = held[f"file://{tmp_path}/g.parquet"]
    assert held[f"file://{tmp_path}/g.parquet"] is g and g.name == "process" and g.vertices.count() == 6


@pytest.mark.parametrize("width", [7, 1000])
def test_callbacks_in_chunks(spark, width):
    rng = random.Random(2)
    rows = [(i * 2, rng.choice(["call", "return", "nop"])) for i in range(120)]
    t = spark.createDataFrame(rows, "idx long, opcode string").repartition(4)
    own = Callbacks()
    step = lambda n, r: (n + (r["opcode"] == "call"), [(r["idx"], n + 1)] if r["opcode"] == "call" else [])
    own.add("calls", Callback(int, step, lambda a, b: a + b, "idx long, n long"))
    # how often each opcode came before its row, among the rows that the callback sees
    seen = lambda d, r: ({**d, r["opcode"]: d.get(r["opcode"], 0) + 1}, [(r["idx"], r["opcode"], d.get(r["opcode"], 0))])
    own.add("before", Callback(dict, seen, lambda a, b: {k: a.get(k, 0) + b.get(k, 0) for k in a | b}, "idx long, opcode string, n long", F.col("opcode") != "nop"))
    with pytest.raises(ValueError):
        own.add("calls", own.held["calls"])
    got = {tuple(r) for r in own.run("calls", t, width=width).collect()}
    assert got == {(i, sum(o == "call" for _, o in rows[: k + 1])) for k, (i, o) in enumerate(rows) if o == "call"}
    got = {tuple(r) for r in own.run("before", t, width=width).collect()}
    assert got == {(i, o, sum(x == o for _, x in rows[:k])) for k, (i, o) in enumerate(rows) if o != "nop"}
    assert own.run("calls", t.limit(0)).collect() == []


def test_the_graph_as_text(spark, process):
    g, high = process
    text = [(r.layer, r.vid, r.line) for r in G.dump(g, F.col("vid").isin(2, 5), events=True).orderBy("layer", "vid", "place").collect()]
    assert [(x, v) for x, v, _ in text] == [("call", 100), ("prov", 2), ("prov", 2), ("prov", 5), ("prov", 5)]
    assert text[0][2] == "call 0x400 plain by 0 t:[55,90]"
    assert text[1][2].startswith("SETBOUNDS pc:0x8 ") and text[2][2] == f"  61 {high + 70:#x} deref_load" and text[4][2] == "  82 0x5000 load"
    assert {r.layer for r in G.dump(g, called=F.col("vid") < 0).collect()} == {"prov"}
    assert G.dump(g, layers=("call",)).count() == 1


def test_binaries_are_found_by_folder(spark, tmp_path):
    for folder, names in (("a", ["libc.so", "kernel"]), ("b", ["libc.so", "kernel.full", "x"]), ("c", ["kernel.full", "kernel"])):
        (tmp_path / folder).mkdir()
        for n in names:
            (tmp_path / folder / n).write_bytes(b"none")
    maps = spark.createDataFrame([(0, 1, 2, "r", "", "/lib/libc.so"), (1, 3, 4, "r", "", "/boot/kernel"), (2, 5, 6, "r", "", "/gone")], "ordinal int, start long, end long, perm string, flag string, path string")
    of = lambda *folders: {r.file: "/".join(r.path.split("/")[-2:]) for r in tables.located(spark, maps, [f"file://{tmp_path}/{f}" for f in folders]).collect()}
    assert of("a", "b") == {"libc.so": "a/libc.so", "kernel": "a/kernel"}
    assert of("b", "a") == {"libc.so": "b/libc.so", "kernel": "b/kernel.full"} and of("c") == {"kernel": "c/kernel.full"}


def test_boundaries_are_written_and_read(spark, tmp_path):
    files = spark.createDataFrame([(1, "a.out", -4096, [-4000, -3000]), (2, "b", 0, [10])], "ordinal long, objfile string, file_base long, tops array<long>")
    tables.save_boundaries(files, f"file://{tmp_path}/bounds")
    assert sorted(tuple(r) for r in tables.load_boundaries(spark, f"file://{tmp_path}/bounds").collect()) == sorted(tuple(r) for r in files.collect())
