"""Predicates over trace rows and graph vertices, and how they combine."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def parse_literal(text: str) -> int:
    """A number in base 10, else in base 16."""
    try:
        return int(text, 10)
    except ValueError:
        return int(text, 16)


def parse_range(text: str) -> tuple[int | None, int | None]:
    """`a-b`, `-b`, `a-` or `a`; None is an open side."""
    low, dash, high = text.strip().partition("-")
    if not dash:
        value = parse_literal(low)
        return value, value
    return (parse_literal(low) if low else None), (parse_literal(high) if high else None)


def in_range(x: Column, low=None, high=None) -> Column:
    """Inclusive; a missing side is open."""
    return S.all_of(*([x >= low] if low is not None else []), *([x <= high] if high is not None else []))


def in_unsigned_range(x: Column, low: int | None = None, high: int | None = None) -> Column:
    raw = lambda v: F.lit(v - (1 << 63))
    key = S.sort_key(x)
    return S.all_of(*([key >= raw(low)] if low is not None else []), *([key <= raw(high)] if high is not None else []))


def combine(tests: Iterable[Column | None], match_any: bool = False) -> Column:
    """AND of the tests that are set, or their OR; without any, all rows match, or none."""
    held = [F.coalesce(t, F.lit(False)) for t in tests if t is not None]
    return S.any_of(*held) if match_any else S.all_of(*held)


# --- trace rows: idx, pc, opcode, ops, is_load, is_store, mem_addr, exception, gprs
def opcode_is(name: str) -> Column:
    return F.col("opcode") == name


def pc_in(low=None, high=None) -> Column:
    return in_unsigned_range(F.col("pc"), low, high)


def access_in(low=None, high=None) -> Column:
    return (F.col("is_load") | F.col("is_store")) & in_unsigned_range(F.col("mem_addr"), low, high)


def uses_register(reg: int) -> Column:
    return F.exists("ops", lambda o: o["reg_num"] == reg)


def exception_is(number: int | None = None) -> Column:
    """That exception, or any."""
    return F.col("exception") != S.NO_EXCEPTION if number is None else F.col("exception") == number


def syscall_is(code: int | None = None, v0: Column | None = None) -> Column:
    test = (F.col("opcode") == "syscall") & (F.col("exception") == 8)
    return test if code is None else test & ((F.col("v0") if v0 is None else v0) == code)


def operand_permission(mask: int) -> Column:
    """Any capability operand has any of the permissions."""
    return F.exists("ops", lambda o: S.has_any(o["perms"], mask))


def is_canonical_nop(code: int | None = None) -> Column:
    """`lui $zero, code`."""
    own = (F.col("opcode") == "lui") & F.coalesce(F.col("ops")[0]["reg_num"] == 0, F.lit(False))
    return own if code is None else own & (F.col("ops")[1]["imm"] == code)


def in_user_code() -> Column:
    """Not in the upper half of the address space."""
    return ~S.is_kernel(F.col("pc"))


# --- vertices
def origin_is(origin: str) -> Column:
    return F.col("origin") == origin


def permission_any(mask: int) -> Column:
    return S.has_any(F.col("perms"), mask)


def object_type_is(otype: int) -> Column:
    return F.col("otype") == otype


def created_in(low=None, high=None) -> Column:
    return in_range(F.col("t_alloc"), low, high)


def length_in(low=None, high=None) -> Column:
    return in_unsigned_range(F.col("length"), low, high)


def lifetime_in(low=None, high=None) -> Column:
    return in_range(S.lifetime(F.col("t_alloc"), F.col("t_free")), low, high)


def with_event(vertices: DataFrame, events: DataFrame, mask: int, low=None, high=None, key: str = "vid") -> DataFrame:
    """The vertices with an event of the kinds in `mask` at an address in the range."""
    hits = events.where(S.has_any(F.col("type"), mask) & in_unsigned_range(F.col("addr"), low, high))
    return vertices.join(hits.select(key), key, "left_semi")


def call_type_is(calls: DataFrame, edges: DataFrame, op: int) -> DataFrame:
    """Calls whose parent edge is of that kind."""
    return calls.join(edges.where(F.col("op") == op).select(F.col("dst").alias("vid")), "vid", "left_semi")


def call_target_is(symbol: str) -> Column:
    return F.col("symbol") == symbol


def layer_is(layer: str) -> Column:
    return F.lit(True) if layer == "all" else F.col("layer") == layer
