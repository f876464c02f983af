"""Small traces to their graphs: pointers, memory, exceptions, branches, calls."""

from pyspark.sql import functions as F

from tracewright.operators import graph, trace
from tracewright.operators.build import CALLS, trace_to_graph
from tracewright.sources.mini_trace import capability as cap
from tracewright.sources.mini_trace import mini_trace

KCC, KDC, PCC = cap(0, 0, 1 << 40), cap(0, 0, 1 << 39), cap(0x1000, 0, 0x1000)
#: Three roots, and user code that runs under pcc.
START = [("csetkcc $c29", {"chwr29": KCC}), ("csetkdc $c30", {"chwr30": KDC}), ("csetepcc $c31", {"chwr31": PCC}), ("eret", {})]


def derived(g):
    """(origin, base, length, base of the parent) of each pointer."""
    v = g.vertices.select("vid", "origin", "base", "length")
    e = g.derivations().select(F.col("dst").alias("vid"), "src").join(g.vertices.select(F.col("vid").alias("src"), F.col("base").alias("parent"), F.col("length").alias("parent_length")), "src", "left")
    return sorted(((r.origin, r.base, r.length, r.parent, r.parent_length) for r in v.join(e, "vid", "left").collect()), key=str)


def built(spark, lines):
    return trace_to_graph(mini_trace(spark, [*START, *lines]))


ROOTS = [("ROOT", 0, 1 << 39, None, None), ("ROOT", 0, 1 << 40, None, None), ("ROOT", 0x1000, 0x1000, None, None)]
DERIVE = [("cgetpcc $c1", {"c1": PCC}), ("csetbounds $c2, $c1, $at", {"c2": cap(0x1100, 0, 0x100)})]


def test_pointers_derive_from_the_program_counter(spark):
    g = built(spark, [*DERIVE, ("candperm $c3, $c2, $at", {"c3": cap(0x1100, 0, 0x100, 7)}), ("cincoffset $c4, $c3, $at", {"c4": cap(0x1100, 8, 0x100, 7)}), ("csub $at, $c4, $c3", {"at": 8})])
    assert derived(g) == sorted([*ROOTS, ("SETBOUNDS", 0x1100, 0x100, 0x1000, 0x1000), ("ANDPERM", 0x1100, 0x100, 0x1100, 0x100)], key=str)
    assert trace.violations(g.vertices, g.derivations()).collect() == []


def test_held_back_instructions_act_at_the_fault_read(spark):
    # $c2 gets another pointer between the fault and the read of its address; two that waited act in their order
    waits = lambda text, c: (text, {text.split()[1][1:].rstrip(","): c, "exc": 4})
    lines = [
        *DERIVE, ("csetbounds $c4, $c1, $at", {"c4": cap(0x1200, 0, 0x80)}), waits("csetbounds $c3, $c2, $at", cap(0x1200, 0, 8)), waits("csetbounds $c6, $c3, $at", cap(0x1200, 0, 4)), ("cmove $c2, $c4", {"c2": cap(0x1200, 0, 0x80)}),
        ("dmfc0 $at, $8", {"at": 0x9000}), ("csetbounds $c5, $c3, $at", {"c5": cap(0x1200, 0, 2)}),
    ]
    g = built(spark, lines)
    got = derived(g)
    for one in (("SETBOUNDS", 0x1200, 8, 0x1200, 0x80), ("SETBOUNDS", 0x1200, 4, 0x1200, 8), ("SETBOUNDS", 0x1200, 2, 0x1200, 8)):
        assert one in got
    # each has the time of its own row
    made = {r.length: r.t_alloc for r in g.vertices.where("base = 4608").collect()}
    assert made[0x80] < made[8] < made[4] < made[2]
    acted = sorted((r.idx, r.sub, r.dst) for r in trace.micro_ops(mini_trace(spark, [*START, *lines])).where("act = 'derive'").collect())
    assert [x[2] for x in acted] == ["r2", "r4", "r3", "r6", "r5"] and acted[2][0] == acted[3][0] == acted[4][0] - 1


def acts(spark, lines):
    """(row, act, dst, src) of the micro-operations."""
    return {(r.idx, r.act, r.dst, r.src) for r in trace.micro_ops(mini_trace(spark, [*START, *lines])).collect()}


def faulting(bad):
    return [*DERIVE, ("cjr $c2", {"exc": 1}), ("nop", {}), ("dmfc0 $at, $8", {"at": bad}), ("cgetepcc $c5", {"c5": PCC}), ("csetbounds $c6, $c5, $at", {"c6": cap(0x1000, 0, 12)}), ("cgetpcc $c7", {"c7": KCC}), ("csetbounds $c8, $c7, $at", {"c8": cap(0x40, 0, 16)})]


def test_a_branch_that_faulted_did_not_happen(spark):
    # epcc is the old program counter, and the handler runs under kcc
    got = derived(built(spark, faulting(0x1018)))
    assert ("SETBOUNDS", 0x1000, 12, 0x1000, 0x1000) in got and ("SETBOUNDS", 0x40, 16, 0, 1 << 40) in got


def test_which_branches_happen(spark):
    went = {bad: (7, "copy", "r64", "r2") in acts(spark, faulting(bad)) for bad in (0x1018, 0x101C, 0x1100)}
    assert went == {0x1018: False, 0x101C: False, 0x1100: True}
    # without an exception a branch goes with its delay slot, and not at all without one
    assert (8, "copy", "r64", "r2") in acts(spark, [*DERIVE, ("cjr $c2", {}), ("nop", {})])
    assert not any(a[2] == "r64" and a[3] == "r2" for a in acts(spark, [*DERIVE, ("cjr $c2", {})]))


def test_held_back_instructions(spark):
    lines = lambda fault: [*DERIVE, ("nop", {}), ("csetbounds $c3, $c2, $at", {"c3": cap(0x1100, 0, 8), "exc": 4}), ("dmfc0 $at, $8", {"at": fault})]
    # one that commits acts at the read of the fault address, row 9
    assert [(9, "derive", "r3", "r2") in acts(spark, lines(fault)) for fault in (0x101C, 0x9999)] == [False, True]


def test_conditional_moves(spark):
    value, lines = cap(0x1100, 0, 0x100), list(DERIVE)
    for opcode, test, moved in (("cmovn", 1, True), ("cmovn", 0, False), ("cmovz", 0, True), ("cmovz", 5, False)):
        lines += [("li $v0", {"v0": test}), (f"{opcode} $c4, $c2, $v0", {"c4": value if moved else cap(1, 0, 1)})]
    assert {a[0] for a in acts(spark, lines) if a[2] == "r4"} == {8, 12}


def test_bulk_clear(spark):
    # c2 is cleared, so what is derived from it has no known parent, and the pointer's life ends
    lines = [*DERIVE, ("cclearlo 0x4", {}), ("nop", {})]
    g = built(spark, lines)
    spans = trace.micro_ops(mini_trace(spark, [*START, *lines])).where("act = 'clear'")
    assert [(r.dst, r.idx) for r in spans.collect()] == [("r2", 7)]
    assert g.vertices.where("origin = 'SETBOUNDS'").count() == 1


def test_memory(spark):
    value = cap(0x1100, 0, 0x100)
    lines = [
        *DERIVE, ("csc $c2, $at, 0($c1)", {"store": 0x2000}), ("clc $c3, $at, 0($c1)", {"load": 0x2000, "c3": value}), ("csetbounds $c4, $c3, $at", {"c4": cap(0x1100, 0, 4)}),
        ("csd $at, $at, 0($c2)", {"store": 0x2008}), ("clc $c5, $at, 0($c1)", {"load": 0x2000, "c5": cap(0, 0, 0, valid=False)}), ("cld $at, $at, 0($c4)", {"load": 0x1100, "at": 1}),
    ]
    lines[2] = ("csc $c2, $at, 0($c1)", {"store": 0x2000, "c2": value})
    g = built(spark, lines)
    assert ("SETBOUNDS", 0x1100, 4, 0x1100, 0x100) in derived(g)
    kinds = {(r.length, r.type & 127) for r in g.events.join(g.vertices, "vid").collect()}
    assert {(0x100, 2), (0x100, 1), (0x100, 64), (0x1000, 8 | 32), (0x1000, 4 | 32), (0x100, 8), (4, 4)} <= kinds


CALL = [("cgetpccsetoffset $c12, $at", {"c12": cap(0x1000, 0x400, 0x1000)}), ("cjalr $c17, $c12", {"c17": cap(0x1000, 0x20, 0x1000)}), ("nop", {})]


def frames(spark, lines):
    return sorted((r.call, r.parent, r.op, r.address, r.closed) for r in trace.call_graph(trace.call_events(mini_trace(spark, [*START, *lines]))).collect())


def test_calls_and_returns(spark):
    lines = [*CALL, ("nop", {"pc": 0x1400}), ("cjr $c12", {}), ("nop", {}), ("cjr $c17", {}), ("nop", {})]
    assert frames(spark, lines) == [(-1, None, 0, None, None), (6, -1, graph.CALL, 0x1400, 11)]
    # a return to where nobody expects it closes nothing
    lines[6] = ("cjr $c17", {"c17": cap(0x1000, 0x999, 0x1000)})
    assert frames(spark, lines)[1][-1] is None
    g = built(spark, [*CALL, ("nop", {"pc": 0x1400}), ("addiu $sp, $sp, -64", {"sp": 100})])
    assert {(r.vid - CALLS, r.address) for r in g.calls.collect()} == {(-1, None), (6, 0x1400)}
    seen = g.edges.where(F.col("op") == graph.VISIBLE).collect()
    assert {tuple(r.regs) for r in seen} >= {(12,)} and {r.dst - CALLS for r in seen} == {6}


def test_more_returns_than_calls_make_new_roots(spark):
    lines = [("jr $ra", {}), ("nop", {}), ("jr $ra", {}), ("nop", {})]
    assert frames(spark, lines) == [(-3, None, 0, None, None), (-2, -3, 0, None, 7), (-1, -2, 0, None, 5)]


def test_system_calls(spark):
    # an indirect system call: the code is in the first argument; frames above it close with it
    lines = [("li $v0", {"v0": 198}), ("li $a0", {"a0": 477}), ("syscall", {"exc": 8}), *CALL, ("eret", {}), ("li $v0", {"v0": 59}), ("syscall", {"exc": 8}), ("nop", {"exc": 0}), ("eret", {}), ("nop", {})]
    got = frames(spark, lines)
    assert got[1][:4] == (7, -1, graph.SYSCALL, 477) and got[2][1] == 7
    assert [r[-1] for r in got[1:3]] == [11, 11]
    # an interrupt within a system call has an eret of its own
    assert got[3] == (13, -1, graph.SYSCALL, 59, None)
    assert [tuple(r) for r in trace.backtrace(trace.call_events(mini_trace(spark, [*START, *lines])), 9).collect()] == [(1, 0x1020, 0x1400), (2, 0x1018, 477)]
