"""Number tests and number-to-text rules."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_finite(value: Column) -> Column:
    """True for a present, non-NaN, non-infinite number; never null."""
    finite = ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
    return F.coalesce(finite, F.lit(False))


def at_least(value: Column, threshold: float) -> Column:
    """Inclusive single-precision comparison in which NaN never passes."""
    single = value.cast("float")
    return ~F.isnan(single) & (single >= F.lit(float(threshold)).cast("float"))


def fixed(value: Column, places: int) -> Column:
    """Text with a fixed number of decimals (at most 4), rounded from the exact binary value.

    Exact ties go to the even digit. Plain arithmetic, which stays in generated code and is much
    faster than a formatter; values that are no decimals (NaN, infinities) keep their plain text.
    """
    v, steps = value.cast("double"), float(2 * 10**places)
    halves = F.rint(v * steps)
    # The value less that many half steps: both products and the first difference are exact, so
    # the sign is right.
    high = v.cast("float").cast("double")
    beyond = (high * steps - halves) + (v - high) * steps
    whole = F.floor(halves / 2)
    up = (halves != whole * 2) & ((beyond > 0) | ((beyond == 0) & (whole % 2 != 0)))
    count = (whole + F.when(up, 1).otherwise(0)).cast("decimal(20,0)")
    step = F.lit(Decimal(1).scaleb(-places))
    # Further out a double has no such decimals to speak of.
    large = F.bround(v.try_cast("decimal(38,18)"), places).cast("string")
    text = F.when(F.abs(v) < 1e11, (count * step).cast("string")).otherwise(large)
    return F.coalesce(text, value.cast("string"))


def plain(value: Column) -> Column:
    """Shortest decimal text, without an exponent or a trailing zero fraction."""
    text = value.cast("string")
    digits = text.try_cast("decimal(38,18)").cast("string")
    return F.coalesce(F.regexp_replace(digits, r"\.?0+$", ""), text)
