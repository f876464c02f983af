"""Instructions of a capability machine: decoding, commit of speculative ones, micro-operations, calls.

A trace row: idx, cycles, pc, opcode, ops (array of struct<reg_num, imm, perms>),
is_load, is_store, mem_addr, exception, reg_num, gpr_val, cap (struct), is_kernel.
Register numbers: general 0-31, floating 32-63, capability 64-95, hardware 96 on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S

CAP = "struct<base:bigint,offset:bigint,length:bigint,perms:int,otype:int,valid:boolean,sealed:boolean>"
TRACE = (
    "idx long, cycles long, pc long, opcode string, ops array<struct<reg_num:int,imm:bigint,perms:int>>, is_load boolean, is_store boolean, "
    f"mem_addr long, exception int, asid int, hwthread int, reg_num int, gpr_val long, cap {CAP}"
)

# The opcodes of each class of capability instructions, as patterns, and the numbers of special registers.
CLASSES = {
    "load": r"^(cl[dc][ri]?|cl[bhw]u?[ri]?|cll[cd]|cll[bhw]u?|clcbi)$",
    "store": r"^(cs[bhwdc][ri]?|csc[cbhwd]|cscbi)$",
    "cast": r"^(ctoptr|cfromptr|cfromddc)$",
    "arith": r"^(cincoffset|csetoffset|csub|cmove|csetaddr)$",
    "bound": r"^(csetbounds|csetboundsexact|candperm)$",
    "flow": r"^(cbtu|cbts|cjr|cjalr|ccall|creturn|cbez|cbnz)$",
    "cpreg": r"^(csetdefault|cgetdefault|cgetepcc|csetepcc|cgetkcc|csetkcc|cgetkdc|csetkdc|cgetpcc|cgetpccsetoffset)$",
    "cmp": r"^(ceq|cne|clt|cle|cltu|cleu|cexeq)$",
    "other": (
        r"^(cgetperm|cgettype|cgetbase|cgetlen|cgettag|cgetsealed|cgetoffset|cseal|cunseal|ccleartag|cclearregs|cgetcause|csetcause|ccheckperm|cchecktype"
        r"|clearlo|clearhi|cclearlo|cclearhi|fpclearlo|fpclearhi|creadhwr|cwritehwr|cgetnull)$"
    ),
}
#: Branches with a delay slot that aren't capability instructions.
PLAIN_FLOW = r"^(j|jal|jr|jalr|b[a-z]+)$"
DDC, KCC, KDC, EPCC, PCC = "r32", "r61", "r62", "r63", "r64"
STACK_CAP, LINK_CAP, RETURN_CAP = 11, 17, 3


def classified(trace: DataFrame) -> DataFrame:
    """Adds `classes`: the class of a capability instruction and `cap`, which joins them; and for every instruction `all`."""
    found = F.filter(F.array(*[F.when(F.col("opcode").rlike(p), F.lit(c)) for c, p in CLASSES.items()]), lambda x: x.isNotNull())
    both = F.when(F.size(found) > 0, F.concat(found, F.array(F.lit("cap")))).otherwise(found)
    return trace.withColumn("classes", F.concat(both, F.array(F.lit("all"))))


def scanned(trace: DataFrame, start: int | None = None, end: int | None = None, backward: bool = False) -> DataFrame:
    """The rows with start <= idx <= end in order of reading."""
    rows = trace
    if start is not None:
        rows = rows.where(F.col("idx") >= start)
    if end is not None:
        rows = rows.where(F.col("idx") <= end)
    return rows.orderBy(F.desc("idx") if backward else F.asc("idx"))


def stopped(trace: DataFrame, stop: Column) -> DataFrame:
    """The rows up to the first for which `stop` holds."""
    first = trace.where(stop).agg(F.min("idx").alias("_stop"))
    return trace.join(F.broadcast(first), F.lit(True)).where(F.col("_stop").isNull() | (F.col("idx") <= F.col("_stop"))).drop("_stop")


def with_delay_slots(trace: DataFrame, chunk: int = 1_000_000) -> DataFrame:
    """Adds in_delay_slot, last_opcode and last_pc, of the row before.

    The order is dealt to chunks; the first row of a chunk gets its predecessor
    from a table with the last row of each.
    """
    held = F.struct(F.col("opcode").alias("o"), F.col("pc").alias("p"))
    own = W.partitionBy("_chunk").orderBy("idx")
    rows = trace.withColumn("_chunk", F.floor(F.col("idx") / chunk).cast("long")).withColumn("_last", F.lag(held).over(own))
    ends = rows.groupBy("_chunk").agg(F.max_by(held, "idx").alias("_end"))
    ends = ends.select("_chunk", F.lag("_end").over(W.orderBy("_chunk")).alias("_carry"))
    joined = rows.join(ends, "_chunk", "left").withColumn("_last", F.coalesce("_last", "_carry"))
    return joined.withColumn("last_opcode", F.col("_last.o")).withColumn("last_pc", F.col("_last.p")).withColumn("in_delay_slot", F.coalesce(F.col("last_opcode").rlike(CLASSES["flow"]) | F.col("last_opcode").rlike(PLAIN_FLOW), F.lit(False))).drop("_chunk", "_last", "_carry")


def register_versions(trace: DataFrame) -> DataFrame:
    """(reg_num, idx, gpr_val, cap, until): the values that each register had."""
    from .lookup import with_next

    return with_next(trace.where("reg_num is not null").select("reg_num", "idx", "gpr_val", "cap"), ["reg_num"], "idx", {"until": "idx"}, 1_000_000.0)


def _is(*kinds: str) -> Column:
    """Whether the opcode is in one of the classes."""
    return S.any_of(*[F.col("opcode").rlike(CLASSES[k]) for k in kinds])


def fault_reads() -> Column:
    """`dmfc0 _, $8`: reads of the address of the last fault."""
    return (F.col("opcode") == "dmfc0") & F.coalesce((F.get("ops", F.lit(1))["reg_num"] == 8) | F.exists("ops", lambda o: o["imm"] == 8), F.lit(False))


def committed(trace: DataFrame, chunk: int = 1_000_000) -> DataFrame:
    """Adds group, committed, bad_addr, acts_at and turn: what becomes of rows with an exception.

    Capability instructions and stores that an exception (neither none nor an
    interrupt) holds back wait for the next read of the fault address.  All that
    wait there are dropped if that address is the one of any of them: of a
    capability load or store the memory address, else the pc.  Those after the last
    such read stay pending (null).  Those that are not dropped act at that read
(acts_at), in the order in which they waited (turn).  bad_addr is the address read next after a row
    with an exception.  Branches act at once, whatever their exception.
    """
    fault = fault_reads()
    raised = F.col("exception") != S.NO_EXCEPTION
    waits = raised & (F.col("exception") != 0) & ~fault & (_is("load", "store", "cast", "arith", "bound", "cpreg", "cmp", "other") | F.col("opcode").isin("cmovn", "cmovz") | F.coalesce("is_store", F.lit(False)))
    addr = F.when(_is("load", "store"), F.coalesce("mem_addr", "pc")).otherwise(F.col("pc"))
    held = trace.where(raised | fault).select("idx", F.when(waits, addr).alias("_addr"), F.when(fault, F.col("gpr_val")).alias("_bad"), fault.alias("_fault"), waits.alias("_waits"))
    # how many fault reads come before: within the row's chunk, and in the chunks before, which a table of sums tells
    held = held.withColumn("_chunk", F.floor(F.col("idx") / chunk).cast("long"))
    own = W.partitionBy("_chunk").orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    inner = held.withColumn("_own", F.coalesce(F.sum(F.col("_fault").cast("long")).over(own), F.lit(0)))
    sums = held.groupBy("_chunk").agg(F.count_if("_fault").alias("_n"))
    before = sums.select("_chunk", F.coalesce(F.sum("_n").over(W.orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    grouped = inner.join(before, "_chunk").withColumn("group", (F.col("_own") + F.col("_before")).cast("long"))
    reads = grouped.where("_fault").select("group", F.col("_bad").alias("bad_addr"), F.col("idx").alias("decided_at"))
    met = grouped.where("not _fault").select("idx", "group", "_addr", "_waits").join(reads, "group", "left")
    dropped = met.where("_waits and decided_at is not null").groupBy("group").agg(F.max(F.col("_addr").eqNullSafe(F.col("bad_addr"))).alias("_dropped"))
    verdict = met.join(dropped, "group", "left").select("idx", "group", "bad_addr", "_waits", F.when(F.col("decided_at").isNotNull(), ~F.coalesce("_dropped", F.lit(False))).alias("_ok"))
    queued = met.where("_waits and decided_at is not null").select("idx", F.col("decided_at").alias("acts_at"), (F.row_number().over(W.partitionBy("group").orderBy("idx")) - 1).alias("turn"))
    out = trace.join(verdict.join(queued, "idx", "left"), "idx", "left")
    return out.withColumn("committed", F.when(F.coalesce("_waits", F.lit(False)), F.col("_ok")).otherwise(F.lit(True))).withColumn("group", F.when(F.col("_waits"), F.col("group"))).drop("_ok", "_waits")


#: What a held-back instruction does has one of the first four places of `sub`; its turn counts in these.
_HELD_BACK = 4
_MICRO = "array<struct<at:bigint,sub:int,act:string,dst:string,src:string,origin:string,flags:int,weak:boolean>>"


def micro_ops(trace: DataFrame, exact_bounds: bool = False) -> DataFrame:
    """The micro-operations of committed instructions, in the schema of `provenance.UOP`.

    Operands are ops[0] (target), ops[1], ...  What an instruction does comes in
    the order of `sub`: dereference, its own rule, what a plain store overwrites,
    the branch whose delay slot it is in, its exception.  A held-back instruction
    that commits acts where the fault address is read, after those that waited
    before it, with the values and the time of its own row.  Opcodes without a rule
    make none.
    """
    rows = committed(trace)
    # a branch waits for its delay slot; without one there is no branch
    slots = rows.select((F.col("idx") - 1).alias("idx"), F.lit(True).alias("_slot"), F.col("committed").alias("_slot_ok"))
    branch = rows.where(F.col("opcode").isin("cjr", "cjalr")).select("idx").join(slots, "idx", "left")
    moves = conditional_moves(rows)
    t = rows.where("committed").join(branch, "idx", "left").join(moves, "idx", "left")
    o = lambda i: F.get("ops", F.lit(i))["reg_num"]
    r = lambda x: F.concat(F.lit("r"), (x - 64).cast("string"))
    op, none, here = F.col("opcode"), F.lit(None).cast("string"), F.col("idx")
    deref = F.when(F.col("is_load"), S.EVENTS["deref_load"]).otherwise(S.EVENTS["deref_store"])

    def row(sub, act, dst=none, src=none, origin=none, flags=None, at=here, weak=False):
        return F.struct(at.alias("at"), F.lit(sub).alias("sub"), F.lit(act).alias("act"), dst.alias("dst"), src.alias("src"), origin.alias("origin"), (F.lit(0) if flags is None else flags).cast("int").alias("flags"), F.lit(weak).alias("weak"))

    bounds = op.isin("csetbounds", "csetboundsimm") | (op.isin("csetboundsexact") if exact_bounds else F.lit(False))
    special = F.when(op.rlike("(ddc|default)$"), DDC).when(op.rlike("kcc$"), KCC).when(op.rlike("kdc$"), KDC).when(op.rlike("epcc$"), EPCC)
    # the register with the address, by the opcode's last letters
    last_or = lambda i: F.coalesce(o(i), F.element_at("ops", -1)["reg_num"])
    short = op.rlike("[ri]$")
    pointer = F.when(op.startswith("cll"), last_or(1)).when(_is("load"), F.when(short, last_or(2)).otherwise(last_or(3)))
    pointer = pointer.when(_is("store"), F.when((op != "csc") & op.startswith("csc"), last_or(2)).when(short, last_or(2)).otherwise(last_or(3)))
    is_cap = op.rlike("^(clc.*|csc|cscbi)$")
    use = row(0, "use", none, r(pointer), none, F.when(is_cap, deref.bitwiseOR(S.EVENTS["deref_is_cap"])).otherwise(deref))
    # a branch with an exception acts at once, and its target is undone if the fault is in the branch or its slot
    faulted = F.col("exception") != S.NO_EXCEPTION
    goes = F.when(faulted, ~F.coalesce((F.col("bad_addr") == F.col("pc")) | (F.col("bad_addr") == F.col("pc") + 4), F.lit(False))).otherwise(F.coalesce(F.col("_slot") & F.col("_slot_ok"), F.lit(False)))
    at = F.when(faulted, here).otherwise(here + 1)
    link = F.when(faulted | goes, F.array(row(4, "copy", r(o(0)), F.lit(PCC), at=at)))
    to = lambda reg: F.when(goes, F.array(row(5, "copy", F.lit(PCC), r(reg), at=at, weak=True)))
    empty = F.array().cast(_MICRO)
    either = lambda *parts: F.concat(*[F.coalesce(x.cast(_MICRO), empty) for x in parts])
    mask, first = F.get("ops", F.lit(0))["imm"], F.when(op == "cclearhi", 16).otherwise(0)
    bits = F.filter(F.sequence(F.lit(0), F.lit(15)), lambda b: F.shiftright(mask, 0).bitwiseAND(F.pow(F.lit(2.0), b.cast("double")).cast("bigint")) != 0)
    here, in_turn = F.coalesce("acts_at", here), F.col("turn") * _HELD_BACK
    own_row = row

    def row(sub, *args, **kw):
        """What waits takes its turn among all that acts at the same row; branches and exceptions don't wait."""
        if sub > _HELD_BACK:
            return own_row(sub, *args, **kw)
        return own_row(sub, *args, **{"at": here} | kw).withField("sub", F.coalesce(in_turn + sub, F.lit(sub)).cast("int"))

    use = use.withField("at", here).withField("sub", F.coalesce(in_turn, F.lit(0)).cast("int"))
    cleared = F.transform(bits, lambda b: row(1, "clear", F.when((op == "cclearlo") & (b == 0), F.lit(DDC)).otherwise(F.concat(F.lit("r"), (first + b).cast("string")))))
    made = (
        F.when(bounds, F.array(row(1, "derive", r(o(0)), r(o(1)), F.lit("SETBOUNDS"))))
        .when(op == "cfromptr", F.array(row(1, "derive", r(o(0)), r(o(1)), F.lit("FROMPTR"))))
        .when(op == "cfromddc", F.array(row(1, "derive", r(o(0)), F.lit(DDC), F.lit("FROMPTR"))))
        .when(op == "candperm", F.array(row(1, "derive", r(o(0)), r(o(1)), F.lit("ANDPERM"))))
        .when(op.isin("cmovn", "cmovz"), F.when(F.col("_moves"), F.array(row(1, "copy", r(o(0)), r(o(1))))))
        .when(_is("arith") | op.isin("cincoffsetimm"), F.array(row(1, "copy", r(o(0)), r(o(1)))))
        .when(op.rlike("^cget(ddc|default|kcc|kdc|epcc)$"), F.array(row(1, "copy", r(o(0)), special)))
        .when(op.rlike("^cset(ddc|default|kcc|kdc|epcc)$"), F.array(row(1, "copy", special, r(o(0)))))
        .when(op.isin("creadhwr", "cwritehwr"), F.array(row(1, "copy", r(o(0)), r(o(1)))))
        .when(op.rlike("^cgetpcc"), F.array(row(1, "copy", r(o(0)), F.lit(PCC))))
        .when(op == "cgetnull", F.array(row(1, "clear", r(o(0)))))
        .when(op.isin("cclearlo", "cclearhi"), cleared)
        .when(op == "cjalr", either(link, to(o(1))))
        .when(op == "cjr", to(o(0)))
        .when(op == "eret", F.array(row(1, "copy", F.lit(PCC), F.lit(EPCC), weak=True)))
        .when(op.rlike("^(clc[ri]?|clcbi)$"), F.array(use, row(1, "load", r(o(0)))))
        .when(op.rlike("^(csc[ri]?|cscbi)$"), F.array(use, row(1, "store", none, r(o(0)))))
        .when(_is("load", "store") & (F.col("is_load") | F.col("is_store")), F.array(use))
    )
    wiped = F.when(F.col("is_store") & (op != "csc"), F.array(row(3, "wipe")))
    taken = F.when(faulted, F.array(row(6, "copy", F.lit(EPCC), F.lit(PCC), weak=True), row(7, "copy", F.lit(PCC), F.lit(KCC), weak=True)))
    each = t.withColumn("_u", F.explode(either(made, wiped, taken)))
    addr = F.when(F.col("is_load") | F.col("is_store"), F.col("mem_addr"))
    word = F.when(F.col("_u.act").isin("wipe", "load", "store"), S.align_down(addr, 16)).otherwise(addr)
    cap = lambda c: F.col(f"cap.{c}").alias(c)
    valid = F.coalesce("cap.valid", F.lit(False)) & ~F.col("_u.weak")
    return each.select(F.col("_u.at").alias("idx"), F.col("_u.sub").alias("sub"), F.col("_u.act").alias("act"), F.col("_u.dst").alias("dst"), F.col("_u.src").alias("src"), word.alias("addr"), valid.alias("valid"), F.col("_u.origin").alias("origin"), "pc", S.is_kernel(F.col("pc")).alias("is_kernel"), cap("base"), cap("offset"), cap("length"), cap("perms"), cap("otype"), cap("sealed"), F.col("_u.flags").alias("flags"), F.col("cycles").alias("time"))


def conditional_moves(trace: DataFrame) -> DataFrame:
    """(idx, _moves): whether a `cmovn` or `cmovz` moved: the target has the source's value, and the third operand isn't zero, or is."""
    asked = trace.where(F.col("opcode").isin("cmovn", "cmovz"))
    values = operand_values(trace, asked)
    pick = lambda n, c: F.max(F.when(F.col("ord") == n, F.col(c)))
    by_row = values.withColumn("_cap", F.to_json("cap")).groupBy("idx").agg(pick(0, "_cap").alias("_to"), pick(1, "_cap").alias("_from"), pick(2, "gpr_val").alias("_test"))
    held = asked.select("idx", "opcode").join(by_row, "idx")
    test = F.when(F.col("opcode") == "cmovn", F.col("_test") != 0).otherwise(F.col("_test") == 0)
    return held.select("idx", F.coalesce((F.col("_to") == F.col("_from")) & test, F.lit(False)).alias("_moves"))


def unsupported(trace: DataFrame) -> DataFrame:
    """Rows whose meaning isn't defined; empty for a trace that can be analysed."""
    return trace.where(F.col("opcode").isin("cseal", "cunseal", "cclearregs", "ccall", "creturn"))


def rejected(trace: DataFrame) -> DataFrame:
    """The trace with `reject`: why a row can't be decoded, or null.  A row needs a place, a pc and an opcode, registers below 128, and an address if it moves memory."""
    odd = F.exists("ops", lambda o: (o["reg_num"] < 0) | (o["reg_num"] > 127)) | ~F.col("reg_num").between(0, 127)
    moves = F.coalesce("is_load", F.lit(False)) | F.coalesce("is_store", F.lit(False))
    reasons = F.when(F.col("idx").isNull(), "no place").when(F.col("pc").isNull(), "no pc").when(F.coalesce(F.trim("opcode"), F.lit("")) == "", "no opcode").when(F.coalesce(odd, F.lit(False)), "unknown register").when(moves & F.col("mem_addr").isNull() & (F.col("exception") == S.NO_EXCEPTION), "no address")
    return trace.withColumn("reject", reasons)


def jumps_without_exec(trace: DataFrame) -> DataFrame:
    """(idx, pc, reg_num, perms): capability branches whose target's capability lacks permission to execute."""
    branches = trace.where(F.col("opcode").isin("cjr", "cjalr"))
    at = F.when(F.col("opcode") == "cjr", 0).otherwise(1)
    values = operand_values(trace, branches).join(branches.select("idx", "pc", at.alias("_at")), "idx").where(F.col("ord") == F.col("_at"))
    return values.where(~S.has_any(F.col("cap.perms"), S.PERMISSIONS["exec"])).select("idx", "pc", "reg_num", F.col("cap.perms").alias("perms"))


#: What two traces of one run have to agree on; what isn't null in the other one is compared.
COMPARED = ("pc", "opcode", "mem_addr", "gpr_val", "valid", "sealed", "base", "length", "offset", "perms", "otype")


def trace_differences(trace: DataFrame, other: DataFrame, pc_only: bool = False) -> DataFrame:
    """(place, idx, other_idx, field, value, other_value): where two traces of one run differ, row by row, without canonical no-operations.

    Opcodes count too, though two disassemblers may name one instruction differently;
    of `mfc0` only the pc does.  A row that one trace alone has differs in `row`.
    """
    from .lookup import zip_compare
    from .predicates import is_canonical_nop

    flat = lambda t: t.where(~is_canonical_nop()).select("idx", "pc", "opcode", "mem_addr", "gpr_val", *[F.col(f"cap.{c}").alias(c) for c in COMPARED[4:]])
    both = zip_compare(flat(trace), flat(other), [], ["idx"], ["idx"], ["idx", *COMPARED])
    known = lambda c: F.col(f"other_{c}").isNotNull() if c not in ("pc", "opcode") else F.lit(True)
    counts = lambda c: F.lit(c == "pc") | (F.lit(not pc_only) & (F.col("opcode") != "mfc0"))
    row = lambda c, field: F.struct(F.lit(field).alias("field"), F.col(c).cast("string").alias("value"), F.col(f"other_{c}").cast("string").alias("other_value"))
    each = F.filter(F.array(*[F.when(known(c) & counts(c) & ~F.col(c).eqNullSafe(F.col(f"other_{c}")), row(c, c)) for c in COMPARED]), lambda x: x.isNotNull())
    alone = F.col("idx").isNull() | F.col("other_idx").isNull()
    found = both.withColumn("_d", F.explode(F.when(alone, F.array(row("idx", "row"))).otherwise(each)))
    return found.select("place", "idx", "other_idx", "_d.field", "_d.value", "_d.other_value")


def named_backtrace(events: DataFrame, end: int, symbols: DataFrame, depth: int | None = None) -> DataFrame:
    """`backtrace` with the symbol at or before each target, and how far behind it the target lies.  symbols: addr, name."""
    from .lookup import floor_lookup

    names = symbols.groupBy("addr").agg(F.min("name").alias("symbol")).withColumn("_at", F.col("addr"))
    found = floor_lookup(backtrace(events, end, depth), names, "target", "addr", ["symbol", "_at"], 1 << 12, unsigned=True)
    return found.withColumn("offset", F.col("target") - F.col("_at")).drop("_at")


def missing_parents(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(vid, parent): derived pointers whose parent is no vertex; empty for a sound graph."""
    gone = edges.where("src is not null").join(vertices.select(F.col("vid").alias("src")), "src", "left_anti")
    return gone.select(F.col("dst").alias("vid"), F.col("src").alias("parent"))


def violations(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(vid, parent, base, top, parent_base, parent_top): derived pointers that reach beyond their parent or have permissions that it lacks."""
    known = vertices.select("vid", "base", "length", S.end_of(F.col("base"), F.col("length")).alias("top"), "perms")
    p = known.select(F.col("vid").alias("src"), F.col("base").alias("parent_base"), F.col("length").alias("_n"), F.col("top").alias("parent_top"), F.col("perms").alias("_p"))
    joined = edges.select("src", "dst").join(p, "src").join(known.withColumnRenamed("vid", "dst"), "dst")
    # ends can have 65 bits
    longer = S.bound(F.col("base"), F.col("length")) > S.bound(F.col("parent_base"), F.col("_n"))
    beyond = ~S.starts_from(F.col("base"), F.col("parent_base")) | longer | (F.col("perms").bitwiseAND(F.bitwise_not("_p")) != 0)
    return joined.where(beyond).select(F.col("dst").alias("vid"), F.col("src").alias("parent"), "base", "top", "parent_base", "parent_top")


def call_events(trace: DataFrame) -> DataFrame:
    """(idx, time, kind, pc, target, expected, raised): calls, system calls, returns and exceptions in order.

    target is the called address, the system call's code, or where a return goes;
    expected is where a call expects to return to; raised: the row has an exception.
    """
    from .lookup import as_of_chunked

    t = committed(trace).where("committed")
    op = F.col("opcode")
    raised = F.col("exception") != S.NO_EXCEPTION
    first = F.get("ops", F.lit(0))["reg_num"]
    kind = (
        F.when(op.isin("cjalr", "jalr") & ~raised, "call").when(((op == "cjr") & (first == 64 + LINK_CAP) | (op == "jr")) & ~raised, "return")
        .when(op == "syscall", "syscall").when(op == "eret", "eret").when(raised, "exception")
    )
    rows = t.select("idx", F.col("cycles").alias("time"), kind.alias("kind"), "pc", raised.alias("raised")).where("kind is not null")
    values = operand_values(trace, t.where(op.isin("cjalr", "jalr", "cjr", "jr")))
    address = F.coalesce(S.cursor(F.col("cap.base"), F.col("cap.offset")), F.col("gpr_val"))
    pick = lambda n: F.max(F.when(F.col("ord") == n, address))
    where = values.groupBy("idx").agg(pick(0).alias("_first"), pick(1).alias("_second"))
    # the code of a system call: what $v0 and $a0 hold then
    gpr = lambda n, name: trace.where(F.col("reg_num") == n).select(F.col("idx").cast("double").alias("at"), F.col("gpr_val").alias(name))
    codes = t.where("opcode = 'syscall'").select("idx", F.col("idx").cast("double").alias("at"))
    for n, name in ((2, "_v0"), (4, "_a0")):
        codes = as_of_chunked(codes, gpr(n, name), [], "at", [name], 2_000_000.0)
    codes = codes.select("idx", S.syscall_code(F.col("_v0"), F.col("_a0")).alias("_code"))
    joined = rows.join(where, "idx", "left").join(codes, "idx", "left")
    target = F.when(F.col("kind") == "call", F.col("_second")).when(F.col("kind") == "return", F.col("_first")).when(F.col("kind") == "syscall", F.col("_code"))
    return joined.select("idx", "time", "kind", "pc", target.alias("target"), F.when(F.col("kind") == "call", F.col("_first")).alias("expected"), "raised")


def visible_pointers(calls: DataFrame, register_pointers: DataFrame, by: list[str] | None = None, registers: int = 64, chunk: float = 2_000_000.0) -> DataFrame:
    """(by..., call, vid, offset, regs): the pointers in registers at each call.

    register_pointers: (by..., reg, idx, until, vid, offset), the spans in which
    registers hold pointers.  Each call asks each register that ever holds one, at
    most `registers`, for the last span before it.
    """
    from .lookup import as_of_chunked

    by = by or []
    spans = register_pointers.where(F.col("reg") < registers)
    names = spans.select("reg").distinct()  # at most `registers` rows
    asked = calls.select(*by, "call", F.col("idx").cast("double").alias("idx")).join(F.broadcast(names), F.lit(True))
    held = spans.select(*by, "reg", F.col("idx").cast("double").alias("idx"), "until", "vid", "offset")
    found = as_of_chunked(asked, held, [*by, "reg"], "idx", ["vid", "offset", "until"], chunk, strict=True)
    live = found.where(F.col("vid").isNotNull() & (F.col("until").isNull() | (F.col("until") >= F.col("idx"))))
    return live.groupBy(*by, "call", "vid", "offset").agg(F.sort_array(F.collect_set("reg")).alias("regs"))


def frame_sizes(trace: DataFrame) -> DataFrame:
    """(pc, frame_size): the first `addiu $sp, $sp, -n` at each place."""
    own = trace.where((F.col("opcode") == "addiu") & (F.col("ops")[0]["reg_num"] == 29) & (F.element_at("ops", -1)["imm"] < 0))
    return own.groupBy("pc").agg(F.min_by(F.abs(F.element_at("ops", -1)["imm"]), "idx").alias("frame_size"))


def initial_stack(trace: DataFrame) -> DataFrame:
    """One row: what the stack capability register and the stack pointer hold at the first eret (cap, sp, at)."""
    first = trace.where("opcode = 'eret'").agg(F.min("idx").alias("at"))
    held = trace.where(F.col("reg_num").isin(64 + STACK_CAP, 29)).join(F.broadcast(first), F.col("idx") < F.col("at"))
    of = lambda reg: F.when(F.col("reg_num") == reg, F.col("idx"))
    return held.agg(F.max_by("cap", of(64 + STACK_CAP)).alias("cap"), F.max_by("gpr_val", of(29)).alias("sp"), F.max("at").alias("at"))


def backtrace(events: DataFrame, end: int, depth: int | None = None) -> DataFrame:
    """(backtrace, pc, target): the calls still open at `end`, the latest first, at most `depth`."""
    open_ = call_graph(events.where(F.col("idx") <= end)).where("op <> 0 and closed is null")
    frames = open_.select(F.row_number().over(W.orderBy(F.desc("call"))).alias("backtrace"), F.col("addr_call").alias("pc"), F.col("address").alias("target"))
    return frames.where(F.col("backtrace") <= depth) if depth is not None else frames


def call_graph(events: DataFrame, width: int = 1_000_000) -> DataFrame:
    """The calls of `call_events`, with callers and returns: see `calls.call_graph`."""
    from . import calls

    return calls.call_graph(events, width)


def dump_lines(trace: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """(idx, line): a line of text per instruction, with its memory access and symbol."""
    t = trace
    if symbols is not None:
        t = t.join(symbols.groupBy(F.col("addr").alias("pc")).agg(F.min("name").alias("symbol")), "pc", "left")
    else:
        t = t.withColumn("symbol", F.lit(None).cast("string"))
    access = F.when(F.col("is_load"), F.concat(F.lit("\n$load [0x"), F.lower(F.hex("mem_addr")), F.lit("]"))).when(F.col("is_store"), F.concat(F.lit("\n$store [0x"), F.lower(F.hex("mem_addr")), F.lit("]"))).otherwise("")
    named = F.when(F.col("symbol").isNotNull(), F.concat(F.lit(" ("), F.col("symbol"), F.lit(")"))).otherwise("")
    except_ = F.when(F.col("exception") != S.NO_EXCEPTION, F.concat(F.lit(" except:"), F.hex("exception"))).otherwise("")
    return t.select("idx", F.concat(F.format_string("{%d:%d} 0x%x %s", F.coalesce("asid", F.lit(0)), "cycles", "pc", "opcode"), except_, named, access).alias("line"))


def dump_registers(trace: DataFrame, at: int) -> DataFrame:
    """(reg_num, line): `[known] $n = value` of the general registers 1 to 31 and the capability registers after the row `at`."""
    held = trace.where((F.col("idx") <= at) & F.col("reg_num").isNotNull()).groupBy("reg_num").agg(F.max_by(F.struct("gpr_val", "cap"), "idx").alias("v"))
    numbers = trace.sparkSession.createDataFrame([(n,) for n in (*range(1, 32), *range(64, 96))], "reg_num int")
    rows = numbers.join(held, "reg_num", "left")
    cap = S.capability_text(*[F.coalesce(f"v.cap.{c}", F.lit(0)) for c in ("base", "offset", "length", "perms", "otype")], F.coalesce("v.cap.valid", F.lit(False)), F.coalesce("v.cap.sealed", F.lit(False)))
    general = F.format_string("[%d] $%d = %s", F.col("v").isNotNull().cast("int"), "reg_num", F.lower(F.hex(F.coalesce("v.gpr_val", F.lit(0)))))
    line = F.when(F.col("reg_num") < 32, general).otherwise(F.format_string("[%d] $c%d = %s", F.col("v").isNotNull().cast("int"), F.col("reg_num") - 64, cap))
    return rows.select("reg_num", line.alias("line"))


def in_order(*parts: DataFrame) -> DataFrame:
    """The rows (idx, line) of several parts of a dump as one, in order."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("idx")


def operand_values(trace: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(idx, ord, reg_num, kind, gpr_val, cap): each operand, of the rows `asked` or of all, with the value that its register held.

    The target (operand 0) has the value after the instruction, the others those
    before it; `$zero` is 0, floating registers are 0, unknown ones null.
    """
    from .lookup import as_of_chunked

    asked = (trace if asked is None else asked).select("idx", F.posexplode("ops").alias("ord", "o")).select("idx", "ord", F.col("o.reg_num").alias("reg_num"), (F.col("idx") * 2 + F.when(F.col("ord") == 0, 1).otherwise(0)).cast("double").alias("at"))
    written = trace.where("reg_num is not null").select("reg_num", (F.col("idx") * 2 + 1).cast("double").alias("at"), F.struct("gpr_val", "cap").alias("value"))
    found = as_of_chunked(asked, written, ["reg_num"], "at", ["value"], 2_000_000.0)
    kind = S.register_class(F.col("reg_num"))
    value = F.when((F.col("reg_num") == 0) | (kind == "fp"), F.lit(0).cast("long")).otherwise(F.col("value.gpr_val"))
    return found.select("idx", "ord", "reg_num", kind.alias("kind"), value.alias("gpr_val"), F.col("value.cap").alias("cap"))


def function_at_jumps(jumps: DataFrame, functions: DataFrame) -> DataFrame:
    """Each jump with the function whose range [lowpc, highpc) its target is in; functions don't overlap."""
    from .lookup import floor_lookup

    found = floor_lookup(jumps, functions.select("lowpc", "highpc", F.col("name").alias("function")), "pc", "lowpc", ["function", "highpc"], 1 << 12, unsigned=True)
    return found.withColumn("function", F.when(S.sort_key(F.col("pc")) < S.sort_key(F.col("highpc")), F.col("function"))).drop("highpc")
