"""Traces from a few lines of assembly, for examples and tests."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from ..functions import scalars as S
from ..operators.trace import TRACE

# The names of general registers, in order of their numbers.
GENERAL = "zero at v0 v1 a0 a1 a2 a3 a4 a5 a6 a7 t0 t1 t2 t3 s0 s1 s2 s3 s4 s5 s6 s7 t8 t9 k0 k1 gp sp fp ra".split()
_FIRST = {"": 0, "f": 32, "c": 64, "chwr": 96}


def register(name: str) -> int:
    """The number of `$3`, `$sp`, `$f2`, `$c5`, `$chwr31`, ..."""
    name = name.removeprefix("$")
    if name in GENERAL:
        return GENERAL.index(name)
    m = re.fullmatch(r"([a-z]*)(\d+)", name)
    if not m or m[1] not in _FIRST:
        raise ValueError(f"unknown register {name!r}")
    return _FIRST[m[1]] + int(m[2])


def operands(text: str) -> list[tuple]:
    """(reg_num, imm, perms) of each operand; `8($c2)` is two."""
    found = []
    for part in filter(None, map(str.strip, text.split(","))):
        for x in filter(None, re.split(r"[()]", part)):
            found.append((register(x), None, 0) if x.startswith("$") else (None, int(x, 0), 0))
    return found


def capability(base: int, offset: int, length: int, perms: int = 0xFFFF, otype: int = 0, sealed: bool = False, valid: bool = True) -> tuple:
    """A value in the order of the trace's struct."""
    return base, offset, length, perms, otype, valid, sealed


def mini_trace(spark: SparkSession, lines: Iterable[tuple[str, dict]], pc: int = 0x1000) -> DataFrame:
    """Rows of `trace.TRACE`: a row per (assembly text, side effects); pc rises by 4, idx and cycles by 1.

    Side effects: a register's name with its new value (a number, or a tuple of
    `capability`), `load` or `store` with the address, `exc` with the exception,
    `pc` to go on from another place.
    """
    rows = []
    for idx, (text, effects) in enumerate(lines, 1):
        effects = dict(effects)
        pc = effects.pop("pc", pc)
        opcode, _, rest = text.partition(" ")
        load, store, raised = effects.pop("load", None), effects.pop("store", None), effects.pop("exc", S.NO_EXCEPTION)
        written = [(register(k), v) for k, v in effects.items()]
        if len(written) > 1:
            raise ValueError(f"{text!r} writes several registers")
        number, value = written[0] if written else (None, None)
        is_cap = isinstance(value, tuple)
        rows.append((idx, idx, pc, opcode, operands(rest), load is not None, store is not None, load if load is not None else store, raised, 0, 0, number, None if is_cap else value, value if is_cap else None))
        pc += 4
    return spark.createDataFrame(rows, TRACE)
