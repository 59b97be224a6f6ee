"""Predicates and aggregates over 64-bit masks used as sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _mask(m: Column | int) -> Column:
    return m if isinstance(m, Column) else F.lit(m).cast("bigint")


def both(col: Column, m: Column | int) -> Column:
    return F.coalesce(col, F.lit(0).cast("bigint")).bitwiseAND(_mask(m))


def has_none(col: Column, m: Column | int) -> Column:
    return both(col, m) == 0


def has_some(col: Column, m: Column | int) -> Column:
    """True as well where nothing is asked for."""
    return (_mask(m) == 0) | (both(col, m) != 0)


def has_all(col: Column, m: Column | int) -> Column:
    return both(col, m) == _mask(m)


def hits(col: Column, m: Column | int) -> Column:
    return F.bit_count(both(col, m)).cast("bigint")


def fits(col: Column, required: int, optional: int, least: int, forbidden: int, unwanted: int = 0, most: int | None = None) -> Column:
    """None forbidden, all required, at least so many optional, at most so many unwanted."""
    if required & forbidden:
        raise ValueError("a bit is both required and forbidden")
    found = has_none(col, forbidden) & has_all(col, required) & (hits(col, optional) >= least)
    return found if most is None else found & (hits(col, unwanted) <= most)


def without(col: Column, m: Column | int) -> Column:
    return col.bitwiseAND(F.bitwise_not(_mask(m)))


def single_bits(col: Column) -> Column:
    """Array of the mask's single bits, ascending."""
    powers = F.transform(F.sequence(F.lit(0), F.lit(62)), lambda i: F.shiftleft(F.lit(1).cast("bigint"), 0) * F.pow(F.lit(2.0), i).cast("bigint"))
    return F.filter(powers, lambda b: col.bitwiseAND(b) != 0)


def any_of(col: Column) -> Column:
    return F.coalesce(F.bit_or(col), F.lit(0).cast("bigint"))


def widened(col: Column, below: dict[int, int]) -> Column:
    """The mask with, for each of its bits, the bits of ``below`` (bit to mask, at most 63)."""
    out = F.coalesce(col, F.lit(0)).cast("bigint")
    for bit, more in sorted(below.items()):
        out = out.bitwiseOR(F.when(both(col, bit) != 0, F.lit(more).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return out
