"""Operators on hand-made tables, against sequential rules or worked-out results."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from tracewright.functions import scalars as S
from tracewright.operators import closure, context, graph, intervals, lookup, predicates, provenance, trace, verify
from tracewright.sources import tables
from tracewright.streaming import context as streams


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_scalars(spark):
    top = F.lit(-1).cast("bigint")
    assert [str(x) for x in one(spark, S.unsigned(top), S.bound(top, top))] == ["18446744073709551615", "36893488147419103230"]
    assert one(spark, S.parse_int(F.lit("0xffffffffffffffff")), S.parse_int(F.lit("42")), S.parse_int(F.lit("zz")), S.parse_hex(F.lit("10"))) == (-1, 42, None, 16)
    assert one(spark, S.permission_names(F.lit(6)), S.permission_names(F.lit(0)), S.rwx_label(F.lit(14)), S.rwx_label(F.lit(0))) == ("exec load", "None", "RWX", "None")
    assert one(spark, S.align_down(F.lit(0x123F).cast("bigint"), 32), S.leading_zeros(F.lit(1).cast("bigint")), S.low_zeros(F.lit(1 << 40).cast("bigint")), S.low_mask(F.lit(4))) == (0x1220, 53, 31, 15)
    assert one(spark, S.basename(F.lit("/a/b.so.1")), S.stem(F.lit("/a/trace.gt")), S.syscall_code(F.lit(198), F.lit(5)), S.cursor(top, F.lit(3).cast("bigint"))) == ("b.so.1", "trace", 5, 2)
    assert one(spark, S.register_class(F.lit(70)), S.register_index(F.lit(70), "cap"), S.register_index(F.lit(70), "gpr")) == ("cap", 6, -1)


@pytest.mark.parametrize("text, want", [("10-20", (10, 20)), ("-ff", (None, 255)), ("7-", (7, None)), ("1f", (31, 31)), ("12", (12, 12))])
def test_ranges(text, want):
    assert predicates.parse_range(text) == want


def test_unset_predicates(spark):
    df = spark.range(4)
    assert df.where(predicates.combine([None, None])).count() == 4
    assert df.where(predicates.combine([None, None], match_any=True)).count() == 0
    assert df.where(predicates.combine([F.col("id") > 0, None, F.col("id") < 3])).count() == 2


def test_greedy_context_against_a_reader(spark):
    rng = random.Random(3)
    rows = [(g, i, rng.random() < 0.3) for g in range(3) for i in range(60)]
    got = {(r.g, r.i): r.kind for r in context.with_greedy_context(spark.createDataFrame(rows, "g int, i int, m boolean"), F.col("m"), ["g"], ["i"], 2, 3).collect()}
    want = {}
    for g in range(3):
        history, left = [], 0
        for _, i, m in [r for r in rows if r[0] == g]:
            if left:
                want[g, i] = "after"
                left -= 1
            elif m:
                want.update({(g, h): "history" for h in history[-2:]})
                history, left = [], 3
                want[g, i] = "anchor"
            else:
                history.append(i)
    assert got == want


@pytest.mark.parametrize("before", [[(0, 10)], [(0, 10), (10, 20)], [(0, 30), (5, 10), (12, 40)], [(50, 60), (0, 10), (55, 70)]])
def test_interval_union(spark, before):
    got = {tuple(r) for r in intervals.union(spark.createDataFrame(before, "s int, e int"), "s", "e").collect()}
    points = {x / 2 for a, b in before for x in range(2 * a, 2 * b + 1)}
    assert {x / 2 for a, b in got for x in range(2 * a, 2 * b + 1)} == points
    assert all(b < c for (_, b), (c, _) in zip(sorted(got), sorted(got)[1:], strict=False))


def test_axis_and_back(spark):
    axis = intervals.segments(spark.createDataFrame([(0, 10), (100, 110), (120, 130)], "s int, e int"), "s", "e").cache()
    there = intervals.to_axis(spark.createDataFrame([(5,), (50,), (105,), (129,)], "v int"), axis, "v")
    back = intervals.from_axis(there, axis, "x").collect()
    assert all(abs(r.value - r.v) < 1e-9 for r in back)
    assert {r.v: round(r.x, 6) for r in back}[5] == 5.0


def test_as_of_in_chunks_equals_as_of(spark):
    rng = random.Random(5)
    left = spark.createDataFrame([(rng.choice("ab"), float(i)) for i in range(0, 300, 2)], "k string, t double")
    right = spark.createDataFrame([(rng.choice("ab"), float(i), i) for i in rng.sample(range(300), 40)], "k string, t double, v int")
    for strict in (False, True):
        plain = sorted(map(tuple, lookup.as_of(left, right, ["k"], "t", ["v"], strict=strict).collect()), key=str)
        for width in (7.0, 90.0, 1000.0):
            assert sorted(map(tuple, lookup.as_of_chunked(left, right, ["k"], "t", ["v"], width, strict=strict).collect()), key=str) == plain


def test_closures(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 5), (8, 9)], "src int, dst int")
    assert {(r.id, r.depth) for r in closure.descendants(edges, spark.createDataFrame([(2,)], "id int")).collect()} == {(2, 0), (3, 1), (4, 2)}
    assert {r.id for r in closure.roots(edges).collect()} == {1, 8}
    assert [r.id for r in closure.tree(edges, spark.createDataFrame([(1,)], "id int")).orderBy("path").collect()] == [1, 2, 3, 4, 5]
    assert {(r.id, r.depth) for r in closure.ancestors(edges, spark.createDataFrame([(4,)], "id int")).where("depth > 0").collect()} == {(3, 1), (2, 2), (1, 3)}
    near = closure.nearest_marked(edges.select(F.col("dst").alias("vid"), F.col("src").alias("parent")), spark.createDataFrame([(1, "a"), (3, "b")], "vid int, mark string"))
    assert {tuple(r) for r in near.collect()} == {(1, "a"), (2, "a"), (5, "a"), (3, "b"), (4, "b")}


def test_brackets_with_expectations(spark):
    rows = [(1, True, False, 8, 0), (2, True, False, 16, 0), (3, False, True, 0, 99), (4, False, True, 0, 16), (5, False, True, 0, 8), (6, False, True, 0, 8), (7, True, False, 4, 0)]
    df = spark.createDataFrame(rows, "i int, o boolean, c boolean, want int, got int")
    assert {tuple(r) for r in closure.match_brackets(df, [], ["i"], "o", "c", "want", "got").collect()} == {(2, 4, 1), (1, 5, 0), (7, None, 0)}


def fold(ops):
    """The sequential rules that `provenance` must equal: vertices, parents, events and ends."""
    regs, mem, made, parents, events, free = {}, {}, {}, {}, [], {}

    stored = {}  # (vid, addr) -> (vid, is stored)

    def real(x):
        return isinstance(x, int)

    def put(reg, v, o):
        old = regs.get(reg, "initial")
        regs[reg] = v
        if real(old) and v is not None and old != v:
            trigger(old, o)

    def trigger(v, o):
        if not any(r == v for r in regs.values()) and not any(on for (w, _), (_, on) in stored.items() if w == v):
            free[v] = o["time"]

    for o in ops:
        at = lambda n, o=o: (o["idx"] * provenance._SUBS + o["sub"]) * provenance._PLACES + n
        cap, act, m, src, dst = (o["base"], o["length"], o["perms"], o["otype"]), o["act"], o["addr"], o["src"], o["dst"]

        def root(n, cap=cap, at=at):
            made[at(n)] = ("ROOT", cap)
            return at(n)

        if act == "root":
            put(dst, root(0), o)
        elif act == "clear":
            put(dst, None, o)
        elif act == "derive":
            made[at(1)] = (o["origin"], cap)
            parents[at(1)] = regs.get(src, "initial")
            put(dst, at(1), o)
        elif act == "copy":
            if o["valid"] and not real(regs.get(src, "initial")):
                put(src, root(0), o)
            held = regs.get(src, "initial")
            put(dst, held if real(held) else None, o)
        elif act == "store" and o["valid"]:
            if not real(regs.get(src, "initial")):
                put(src, root(0), o)
            if mem.get(m):
                events.append((mem[m][0], m, 64))
                stored[mem[m][0], m] = (mem[m][0], False)
                mem_old = mem[m][0]
                mem[m] = (regs[src], cap)
                trigger(mem_old, o)
            mem[m] = (regs[src], cap)
            events.append((regs[src], m, 2))
            stored[regs[src], m] = (regs[src], True)
        elif act == "load":
            if o["valid"]:
                if not (mem.get(m) and mem[m][1] == cap):
                    mem[m] = (root(0), cap)
                put(dst, mem[m][0], o)
                events.append((mem[m][0], m, 1))
            else:
                mem[m] = None
                put(dst, None, o)
        elif act == "wipe" and mem.get(m):
            events.append((mem[m][0], m, 64))
            stored[mem[m][0], m] = (mem[m][0], False)
            trigger(mem[m][0], o)
        elif act == "use" and real(regs.get(src, "initial")):
            events.append((regs[src], m, 4))
    return made, parents, sorted(events), free


@pytest.mark.parametrize("seed, chunk", [(1, 7), (2, 50), (3, 100_000)])
def test_provenance_against_the_sequential_rules(spark, seed, chunk):
    rng = random.Random(seed)
    ops = []
    for i in range(90):
        act = rng.choice(["root", "clear", "derive", "copy", "copy", "copy", "store", "load", "wipe", "use"])
        ops.append({"idx": i, "sub": 0, "act": act, "dst": f"r{rng.randint(0, 5)}", "src": f"r{rng.randint(0, 5)}", "addr": rng.choice([16, 32, 48]), "valid": rng.random() < 0.6, "origin": "SETBOUNDS", "pc": 4 * i, "is_kernel": True, "base": rng.choice([0, 4096]), "offset": 0, "length": rng.choice([16, 32]), "perms": 7, "otype": 0, "sealed": False, "flags": 4, "time": i})
    df = spark.createDataFrame([tuple(o[c.split()[0]] for c in provenance.UOP.split(", ")) for o in ops], provenance.UOP)
    made, parents, events, free = fold(ops)
    p = provenance.provenance(df, chunk_rows=chunk)
    vertices = p.vertices.cache()
    assert {r.vid: (r.origin, (r.base, r.length, r.perms, r.otype)) for r in vertices.where("vid >= 0").collect()} == made
    assert {r.vid: r.t_free for r in vertices.where("vid >= 0").collect()} == {v: free.get(v, -1) for v in made}
    assert {r.dst: "initial" if r.src is not None and r.src < 0 else r.src for r in p.edges.collect()} == parents
    assert sorted((r.vid, r.addr, r.type) for r in p.events.collect()) == events


def test_commit_of_speculative_rows(spark):
    none = [None] * 3
    row = lambda i, op, exc=31, pc=None, mem=None, gpr=None, imm=None: (i, i, pc or 4 * i, op, [(1, imm, 0)], mem is not None, False, mem, exc, 0, 0, None, gpr, None)
    rows = [row(1, "cmove"), row(2, "csetbounds", 4, pc=100), row(3, "clc", 4, mem=64), row(4, "dmfc0", gpr=64, imm=8), row(5, "cmove", 4, pc=200), row(6, "dmfc0", gpr=999, imm=8), row(7, "cmove", 4, pc=300)]
    got = {r.idx: r.committed for r in trace.committed(spark.createDataFrame(rows, trace.TRACE)).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 5: True, 6: True, 7: None} and none


def test_masks_and_fusion(spark):
    v = [(1, "ROOT", 0, False, 0, 0, 0, 6, 0, True, False, 1, -1), (2, "FROMPTR", 4, False, 64, 0, 64, 6, 0, True, False, 2, 9), (3, "SETBOUNDS", 8, True, 64, 0, 16, 6, 0, True, False, 3, 12), (4, "ANDPERM", 8, True, 64, 0, 16, 2, 0, False, False, 4, -1)]
    events = [(2, 5, 64, 4), (3, 6, 70, 8 | 128), (3, 7, 4096, 2), (3, 9, 4096, 64)]
    edges = [(1, 1, 2, 0, None, None, None), (2, 2, 3, 0, None, None, None), (3, 3, 4, 0, None, None, None)]
    g = graph.Graph(spark.createDataFrame(v, graph.VERTEX), spark.createDataFrame(events, graph.EVENT), spark.createDataFrame([], graph.CALL_VERTEX), spark.createDataFrame(edges, graph.EDGE), "g")
    ids = lambda x: {r.vid for r in x.vertices.select("vid").collect()}
    assert ids(graph.without_null(g)) == {2, 3} and ids(graph.without_kernel(g)) == {1, 2} and ids(graph.without_roots(g)) == {2, 3, 4}
    assert ids(graph.time_slice(6, 7, creation=False, deref=True)(g)) == {3}
    fused = graph.fuse_bounds(g)
    assert {(r.vid, r.origin, r.t_alloc, r.t_free) for r in fused.vertices.where("vid in (2, 3)").collect()} == {(3, "PTR_SETBOUNDS", 2, 12)}
    assert {r.vid for r in fused.events.select("vid").collect()} == {3} and {(r.src, r.dst) for r in fused.edges.collect()} == {(1, 3), (3, 4)}
    assert graph.active_memory(g.events).count() == 0
    assert {r.vid: r.annotated_stack for r in graph.stack_pointers(g.vertices.where("vid = 2"))(g).vertices.collect()} == {1: False, 2: True, 3: True, 4: True}
    assert graph.statistics(g).first()["deref_loads"] == 1
    assert any("SETBOUNDS" in r.line for r in graph.dump_vertices(g).collect())


def test_graph_on_disk(spark, tmp_path):
    g = graph.Graph(spark.createDataFrame([], graph.VERTEX), spark.createDataFrame([(1, 2, 3, 4)], graph.EVENT), spark.createDataFrame([], graph.CALL_VERTEX), spark.createDataFrame([], graph.EDGE))
    tables.save_graph(g, f"file://{tmp_path}/run1.gt")
    again = tables.load_graph(spark, f"file://{tmp_path}/run1.gt")
    assert again.name == "run1" and again.events.count() == 1


def test_bounds(spark):
    rows = [("OBJECT", 0, 16, 16), ("OBJECT", 0, 8, 16), ("OBJECT", 0, 5000, 5000), ("OBJECT", 8, 1 << 20, 1 << 20), ("FUNC", 64, 100, 1), ("FUNC", 65, 100, 1), ("NOTYPE", 0, 0, 0), (None, 0, 0, 0)]
    df = spark.createDataFrame([(*r, 64, [200]) for r in rows], "type string, base long, length long, size long, file_base long, tops array<long>")
    got = [r.verdict for r in verify.bound_verdict(df).collect()]
    assert got[:2] == ["exact", "too_short"] and got[4:] == ["function", "outside", "notype", "unknown"]
    counts = {r.verdict: r.n for r in verify.counted(verify.bound_verdict(df), "verdict").collect()}
    assert counts["function"] == 1 and counts["misaligned"] + counts["exact"] + counts["padded"] == 3 and sum(counts.values()) == 8


def test_memory_maps(spark, tmp_path):
    (tmp_path / "a.csv").write_text("0x1000,8192,0,r-x,1,1,1,0,CN,vn,/lib/libc.so\n0x7fff000000,0x7fff100000,0,rw-,1,1,1,0,D,df,\n")
    (tmp_path / "b.txt").write_text(" 12 1000 2000 r-x 1 1 1 0 CN-- vn /bin/a\n 12 3000 4000 rw- 1 1 1 0 ---D df\n")
    a = tables.vmmap(spark, f"file://{tmp_path}/a.csv")
    assert {(r.start, r.end, r.path) for r in a.collect()} == {(4096, 8192, "/lib/libc.so"), (0x7FFF000000, 0x7FFF100000, "")}
    assert tables.stack_map(a).first()["start"] == 0x7FFF000000
    assert {(r.start, r.flag, r.path) for r in tables.vmmap(spark, f"file://{tmp_path}/b.txt").collect()} == {(4096, "CN--", "/bin/a"), (0x3000, "---D", "")}


def test_elf(spark, tmp_path):
    strings = b"\0main\0"
    names = b"\0.symtab\0.strtab\0__cap_relocs\0.shstrtab\0"
    symtab = struct.pack(">IBBHQQ", 0, 0, 0, 0, 0, 0) + struct.pack(">IBBHQQ", 1, 2, 0, 1, 0x40, 24)
    reloc = struct.pack(">5Q", 0x2000, 0x3000, 8, 16, 7)
    body, at = b"", 64
    sections = [(0, 0, 0, 0, 0, 0)]
    for name, kind, data, link in ((1, 2, symtab, 2), (9, 3, strings, 0), (17, 1, reloc, 0), (30, 3, names, 0)):
        sections.append((name, kind, 0, at + len(body), len(data), link))
        body += data
    head = b"\x7fELF\x02\x02\x01" + bytes(9) + struct.pack(">HHIQQQIHHHHHH", 3, 8, 1, 0, 0, 64 + len(body), 0, 64, 0, 0, 64, 5, 4)
    table = b"".join(struct.pack(">IIQQQQIIQQ", n, k, 0, a, o, s, link, 0, 0, 0) for n, k, a, o, s, link in sections)
    (tmp_path / "lib.so").write_bytes(head + body + table)
    maps = spark.createDataFrame([(0, 0x10000, 0x20000, "r-x", "", "/x/lib.so")], "ordinal int, start long, end long, perm string, flag string, path string")
    rows = tables.elf_rows(spark, [f"file://{tmp_path}/lib.so"], maps).cache()
    assert [(r.name, r.addr, r.size, r.type) for r in tables.symbols(rows).collect()] == [("main", 0x10040, 24, "FUNC")]
    assert [(r.base, r.length, r.perms) for r in tables.relocations(rows).collect()] == [(0x3000, 16, 7)]


def test_text_trace(spark):
    text = ["noise", "0x1000: clc $c3,$zero,0($c1)", "    Write C3|v:1 s:0 p:00007ffd b:0000000000001000 l:0000000000000100", "     |o:0000000000000010 t:ffffff", "    Cap Memory Read [0000000000002000]", "0x1004: daddiu $4,$4,1", "    Write 4 = 00000000000000ff"]
    rows = {r.instr: r for r in tables.text_trace(spark.createDataFrame(list(enumerate(text)), "line_no long, value string")).collect()}
    assert (rows[1].pc, rows[1].opcode, rows[1].cap_reg, rows[1].base, rows[1].length, rows[1].offset, rows[1].otype, rows[1].access, rows[1].mem_addr) == (0x1000, "clc", 3, 0x1000, 0x100, 0x10, 0xFFFFFF, "read", 0x2000)
    assert (rows[2].reg, rows[2].gpr_val, rows[2].valid) == ("4", 255, None)


def test_debug_information(spark):
    f = '[{"name": "f", "lowpc": 16, "highpc": 64, "parameters": [{"name": "p", "line": 3}], "variables": [], "blocks": [{"variables": [{"name": "q", "line": 5}], "blocks": [{"variables": [{"name": "r", "line": 6}]}]}]}]'
    functions = tables.dwarf_functions(spark.createDataFrame([(f,)], "value string"), base=F.lit(100)).cache()
    assert [(r.name, r.lowpc, [v.name for v in r.variables]) for r in functions.collect()] == [("f", 116, ["p", "q", "r"])]
    notes = spark.createDataFrame([('{"f": {"q": {"line_number": 5, "expected_length": 32}, "r": {"line_number": 7, "expected_length": 8}}}',)], "value string")
    assert [tuple(r) for r in tables.annotated(functions, notes).collect()] == [("f", "q", 5, 32)]
    assert tables.overlapping_functions(spark.createDataFrame([(0, 10), (5, 20), (20, 30)], "lowpc long, highpc long")).count() == 1


def test_tasks():
    assert tables.run_tasks("# all\nadd 1 2 # sum\n\nadd 3\n", {"add": lambda *x: sum(map(int, x))}) == [3, 3]
    with pytest.raises(ValueError, match="unknown action"):
        tables.run_tasks("plot x", {})


def test_streams(spark, tmp_path):
    rows = [(1, i, m) for i, m in enumerate("uukkuk")] + [(2, i, m) for i, m in enumerate("kku")]
    df = spark.createDataFrame(rows, "k int, i int, m string")
    df.write.parquet(f"file://{tmp_path}/in")
    source = spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in")
    q = streams.mode_switches(source, "k", "i", "m").writeStream.format("memory").queryName("switches").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.sql("select * from switches").collect()} == {(1, 2, "k", "u"), (1, 4, "u", "k"), (1, 5, "k", "u"), (2, 2, "u", "k")}


def test_operand_values(spark):
    rows = [(i, i, 4 * i, op, [(r, None, 0) for r in regs], False, False, None, 31, 0, 0, w, v, None) for i, op, regs, w, v in ((1, "li", [4], 4, 7), (2, "addiu", [4, 4, 0], 4, 8), (3, "move", [5, 4, 33], 5, 8))]
    got = {(r.idx, r.ord): r.gpr_val for r in trace.operand_values(spark.createDataFrame(rows, trace.TRACE)).collect()}
    assert got == {(1, 0): 7, (2, 0): 8, (2, 1): 7, (2, 2): 0, (3, 0): 8, (3, 1): 8, (3, 2): 0}
    functions = spark.createDataFrame([("f", 0, 10), ("g", 20, 30)], "name string, lowpc long, highpc long")
    found = trace.function_at_jumps(spark.createDataFrame([(5,), (15,), (25,)], "pc long"), functions)
    assert {r.pc: r.function for r in found.collect()} == {5: "f", 15: None, 25: "g"}


def test_small_tables(spark):
    from tracewright.operators import distribution

    assert distribution.baseline_cdf(spark).count() == 3
    bars = distribution.stacked(spark.createDataFrame([("a", 0, 2), ("a", 1, 3)], "k string, bin int, n long"), ["k"])
    assert {(r.bin, r["from"], r.to) for r in bars.collect()} == {(0, 0, 2), (1, 2, 5)}
    caps = "base long, length long, perms int, otype int, valid boolean, sealed boolean"
    snapshot = spark.createDataFrame([(0, 8, 7, 0, True, False, 5), (0, 8, 7, 0, True, False, 3)], f"{caps}, reg int")
    got = lookup.compatible_register(spark.createDataFrame([(1, 0, 8, 7, 0, True, False), (2, 1, 8, 7, 0, True, False)], f"id int, {caps}"), snapshot, ["id"])
    assert {tuple(r) for r in got.collect()} == {(1, 3), (2, None)}


def test_cycles_and_wide_intervals(spark):
    with pytest.raises(Exception, match="cycle|OVERFLOW"):
        closure.roots_by_doubling(spark.createDataFrame([(1, 2), (2, 1)], "id long, parent long"))
    rng = random.Random(9)
    wide = [(i, a, a + rng.choice([0, 3, 40, 5000, 1 << 47])) for i, a in enumerate(rng.sample(range(1 << 20), 60))]
    points = [(i, rng.randrange(1 << 21)) for i in range(80)]
    df, p = spark.createDataFrame(wide, "i int, s long, e long"), spark.createDataFrame(points, "j int, v long")
    got = {(r.j, r.i) for r in lookup.points_in_intervals(p, df, "v", "s", "e", 8).collect()}
    assert got == {(j, i) for j, v in points for i, a, b in wide if a <= v <= b}
    other = spark.createDataFrame([(i + 100, a + 7, b + 7) for i, a, b in wide], "k int, s2 long, e2 long")
    rows = [(r.i, r.k) for r in lookup.overlapping(df, other, "s", "e", "s2", "e2", 8).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {(i, k + 100) for i, a, b in wide for k, c, d in wide if a <= d + 7 and c + 7 <= b}


def test_deep_blocks_relocations_and_labels(spark):
    import json

    from tracewright.operators import distribution

    nested = {"blocks": [{"variables": [{"name": "c"}], "blocks": [{"blocks": [{"variables": [{"name": "d"}]}]}]}]}
    text = json.dumps([{"name": "f", "lowpc": 4, "highpc": 8, "parameters": [{"name": "a"}], "variables": [{"name": "b"}], **nested}])
    rows = tables.dwarf_functions(spark.createDataFrame([(text,), (None,)], "value string"), base=F.lit(100)).collect()
    assert [(r.lowpc, [v.name for v in r.variables]) for r in rows] == [(104, ["a", "b", "c", "d"])]
    lines = [("a.out", "  0x0000000000011f58 Base: 0x0000000000011000 (x.y+0) Length: 24 Perms: Constant"), ("a.out", "0x10 (f) Base: 0x20 (<f>+0) Length: 8 Perms: Function"), ("a.out", "Relocations:")]
    got = [tuple(r) for r in tables.readelf_relocations(spark.createDataFrame(lines, "objfile string, value string")).collect()]
    assert got == [("a.out", 0x11F58, 0x11000, 24, "OBJECT"), ("a.out", 0x10, 0x20, 8, "FUNC")]
    bars = spark.createDataFrame([(4096,), (255,)], "start long")
    maps = spark.createDataFrame([(4096, "rw-", "/lib/libc.so")], "start long, perm string, path string")
    assert {r.start: r.label for r in distribution.bar_labels(bars, maps).collect()} == {4096: "(rw-) libc.so", 255: "0xff"}
    assert one(spark, distribution.scaled(F.lit(2_500_000))) == (2.5,)


def test_windows_and_depths_of_streams(spark, tmp_path):
    import datetime

    rows = [(1, i, datetime.datetime(2024, 1, 1, 0, i), i % 3 != 2, i % 3 == 2) for i in range(9)]
    spark.createDataFrame(rows, "k int, i int, t timestamp, o boolean, c boolean").repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("k int, i int, t timestamp, o boolean, c boolean").parquet(f"file://{tmp_path}/in")
    for name, out in (("depths", streams.depths(stream, "k", "i", "o", "c")), ("flags", streams.windowed_flags(stream, "t", "k", F.when(F.col("o"), 1).otherwise(2)))):
        q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"file://{tmp_path}/{name}").start()
        q.processAllAvailable()
        q.stop()
    depth, want = 0, []
    for _, i, _, o, c in rows:
        depth = depth + 1 if o else max(0, depth - 1) if c else depth
        want.append((1, i, depth))
    assert sorted(tuple(r) for r in spark.sql("select * from depths").collect()) == want
    done = spark.sql("select k, n, flags from flags").collect()
    assert all(tuple(r) == (1, 5, 3) for r in done)
