"""Rounding, clamping and exact money sums as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_to(value: Column, digits: int) -> Column:
    """Round half up on the double itself.

    ``floor(x * 10^d + 0.5) / 10^d`` gives the same bits in every IEEE engine,
    which the built-in ``round`` does not on exact halves.
    """
    scale = float(10 ** digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def cents(value: Column) -> Column:
    return round_to(value, 2)


def clamp(value: Column, low: Column | float, high: Column | float) -> Column:
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    return F.least(F.greatest(value, low), high)


def to_cents(value: Column) -> Column:
    """Money as a whole number of cents.

    Sums of it are exact and independent of the order of the rows, and stay primitive
    longs, where sums of decimals beyond 18 digits would be objects. A total beyond
    92 quadrillion raises an error rather than losing digits.
    """
    return F.floor(value * F.lit(100.0) + F.lit(0.5))


def from_cents(amount: Column) -> Column:
    return amount / F.lit(100.0)


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields NULL for a zero denominator under ANSI mode."""
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))
