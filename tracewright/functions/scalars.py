"""Column functions for addresses, capabilities and instruction fields.

Addresses are unsigned 64-bit numbers held as two's-complement BIGINT.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The bits of capability permissions, event types and vertex origins.
PERMISSIONS = {"global": 1, "exec": 2, "load": 4, "store": 8, "load_cap": 16, "store_cap": 32, "store_local_cap": 64, "seal": 128, "ccall": 256, "unseal": 512, "system_registers": 1024}
EVENTS = {"load": 1, "store": 2, "deref_load": 4, "deref_store": 8, "deref_call": 16, "deref_is_cap": 32, "delete": 64, "usr": 128}
NO_EXCEPTION = 31

DEC20, DEC21 = "decimal(20,0)", "decimal(21,0)"


def unsigned(x: Column) -> Column:
    """The number as DECIMAL(20,0), for results."""
    return F.when(x < 0, x.cast(DEC20) + F.lit("18446744073709551616").cast(DEC20)).otherwise(x.cast(DEC20)).cast(DEC20)


def signed(x: Column) -> Column:
    """A DECIMAL below 2^64 as raw BIGINT."""
    high = F.lit("9223372036854775808").cast(DEC21)
    return F.when(x >= high, x - F.lit("18446744073709551616").cast(DEC21)).otherwise(x).cast("bigint")


def sort_key(x: Column) -> Column:
    """A BIGINT that orders as the unsigned number does."""
    return x.bitwiseXOR(F.lit(-(1 << 63)))


def bound(base: Column, length: Column) -> Column:
    """base + length, which can have 65 bits."""
    return (unsigned(base).cast(DEC21) + unsigned(length).cast(DEC21)).cast(DEC21)


def ends_by(base: Column, length: Column, limit: Column) -> Column:
    """Whether base + length, which can have 65 bits, is at most the address `limit`."""
    small = (base >= 0) & (length >= 0) & (limit >= 0) & (length <= F.lit((1 << 63) - 1) - F.when(base >= 0, base).otherwise(0))
    return F.when(small, F.when(small, base + length) <= limit).otherwise(bound(base, length) <= unsigned(limit).cast(DEC21))


def starts_from(base: Column, limit: Column) -> Column:
    """Whether the address is at least `limit`."""
    return sort_key(base) >= sort_key(limit)


def end_of(base: Column, length: Column) -> Column:
    """base + length modulo 2^64, as a raw BIGINT."""
    return F.coalesce(F.try_add(base, length), cursor(base, length))


def cursor(base: Column, offset: Column) -> Column:
    """base + offset modulo 2^64, as a raw BIGINT."""
    return signed(F.pmod(unsigned(base).cast("decimal(22,0)") + unsigned(offset).cast("decimal(22,0)"), F.lit("18446744073709551616").cast("decimal(22,0)")))


def is_kernel(pc: Column) -> Column:
    return pc < 0


def has_any(bits: Column, mask: int) -> Column:
    return bits.bitwiseAND(F.lit(mask)) != 0


def permission_names(bits: Column) -> Column:
    """The names of the set bits with blanks between; `None` without any."""
    names = F.array_join(F.filter(F.array(*[F.when(has_any(bits, b), F.lit(n)) for n, b in PERMISSIONS.items()]), lambda x: x.isNotNull()), " ")
    return F.when(names == "", F.lit("None")).otherwise(names)


def rwx_label(bits: Column) -> Column:
    """R, W and X for load, store and exec; `None` without any."""
    text = F.concat(*[F.when(has_any(bits, PERMISSIONS[p]), F.lit(c)).otherwise("") for p, c in (("load", "R"), ("store", "W"), ("exec", "X"))])
    return F.when(text == "", F.lit("None")).otherwise(text)


def capability_text(base: Column, offset: Column, length: Column, perms: Column, otype: Column, valid: Column, sealed: Column) -> Column:
    flag = lambda c: F.when(c, F.lit("1")).otherwise("0")
    return F.format_string("[b:%s o:%s l:%s p:%s t:%s v:%s s:%s]", F.hex(base), F.hex(offset), F.hex(length), permission_names(perms), F.hex(otype), flag(valid), flag(sealed))


def align_down(addr: Column, size: int) -> Column:
    return addr.bitwiseAND(F.lit(-size))


def leading_zeros(x: Column) -> Column:
    """min(53, 65 - bits), bits being those of the unsigned number."""
    bits = F.when(x == 0, 0).otherwise(F.length(F.bin(x)))
    return F.least(F.lit(53), 65 - bits).cast("int")


def low_zeros(length: Column) -> Column:
    """How many low bits of base and top are zero for a capability of that length."""
    return (52 - leading_zeros(length) + 3).cast("int")


def low_mask(n: Column) -> Column:
    return F.expr("1L") * F.pow(F.lit(2.0), n.cast("double")).cast("bigint") - 1


def aligned(x: Column, n: Column) -> Column:
    return x.bitwiseAND(low_mask(n)) == 0


def hex_text(x: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(x)))


def parse_int(text: Column) -> Column:
    """Decimal, or hexadecimal with or without 0x, as raw BIGINT; null if neither."""
    t = F.trim(text)
    decimal = F.when(t.rlike(r"^\d{1,20}$"), signed(F.expr("0").cast(DEC21) + t.try_cast(DEC21)))
    digits = F.regexp_extract(t, r"^(?:0[xX])?([0-9a-fA-F]{1,16})$", 1)
    return F.coalesce(decimal, F.when(digits != "", signed(F.conv(digits, 16, 10).cast(DEC21))))


def parse_hex(text: Column) -> Column:
    digits = F.regexp_extract(F.trim(text), r"^(?:0[xX])?([0-9a-fA-F]{1,16})$", 1)
    return F.when(digits != "", signed(F.conv(digits, 16, 10).cast(DEC21)))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """The file name without its folder and last extension."""
    return F.regexp_replace(basename(path), r"(.)\.[^.]*$", "$1")


def syscall_code(v0: Column, a0: Column) -> Column:
    """v0, or a0 for the indirect system calls 0 and 198."""
    return F.when(v0.isin(0, 198), a0).otherwise(v0)


def round_top(base: Column, top: Column, mask: Column) -> Column:
    """The top of an object rounded up to its alignment."""
    return base + (top - base + mask).bitwiseAND(F.bitwise_not(mask))


def lifetime(t_alloc: Column, t_free: Column) -> Column:
    """Infinity while it isn't freed (-1)."""
    return F.when(t_free >= 0, (t_free - t_alloc).cast("double")).otherwise(float("inf"))


def any_of(*tests: Column) -> Column:
    return reduce(lambda x, y: x | y, tests, F.lit(False))


def all_of(*tests: Column) -> Column:
    return reduce(lambda x, y: x & y, tests, F.lit(True))


def register_class(reg: Column) -> Column:
    """gpr below 32, fp below 64, cap below 96, then hw."""
    return F.when(reg < 32, "gpr").when(reg < 64, "fp").when(reg < 96, "cap").otherwise("hw")


def register_index(reg: Column, kind: str) -> Column:
    """The number within the class, -1 for registers of other classes."""
    first = {"gpr": 0, "fp": 32, "cap": 64, "hw": 96}[kind]
    return F.when(register_class(reg) == kind, reg - first).otherwise(-1)
