"""Unsigned 64-bit arithmetic on LONG columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOWEST = -(1 << 63)


def signed(number: int) -> int:
    """The LONG that has the bits of an unsigned 64-bit number."""
    return number - (1 << 64) if number >= 1 << 63 else number


def flipped(x: Column) -> Column:
    """Orders as the unsigned number does."""
    return x.bitwiseXOR(F.lit(LOWEST))


def compare(left: Column, operator: str, right: Column) -> Column:
    """Unsigned comparison; ``operator`` is one of eq ne lt le gt ge."""
    a, b = flipped(left), flipped(right)
    return {"eq": left == right, "ne": left != right, "lt": a < b, "le": a <= b, "gt": a > b, "ge": a >= b}[operator]


def shift_right(x: Column, bits: int) -> Column:
    """Logical shift; 0 from 64 bits on."""
    return F.shiftrightunsigned(x, bits) if bits < 64 else F.lit(0).cast("long")


def bit_field(x: Column, first_bit: int, bit_count: int) -> Column:
    """``bit_count`` bits from ``first_bit`` on; bits from 64 on read 0."""
    mask = signed((1 << min(bit_count, 64)) - 1)
    return shift_right(x, first_bit).bitwiseAND(F.lit(mask))


def decimal_text(x: Column) -> Column:
    """The unsigned number in decimal."""
    whole = F.lit(1 << 62).cast("decimal(38,0)") * 4
    return F.when(x >= 0, x.cast("string")).otherwise((x.cast("decimal(38,0)") + whole).cast("decimal(20,0)").cast("string"))


def floor_div(x: Column, n: int) -> Column:
    """Whole division of LONGs, rounded down; exact where a double would not be."""
    return F.call_function("div", x - F.pmod(x, F.lit(n)), F.lit(n))
