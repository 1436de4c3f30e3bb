"""Numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_even(value: Column, digits: int | None) -> Column:
    """Round half to even on the scaled value; ``None`` leaves the value alone.

    Stays with doubles, which is far cheaper than decimal rounding. Never yields -0.0.
    """
    if digits is None:
        return value
    scale = F.lit(float(10**digits))
    return F.rint(value * scale) / scale + F.lit(0.0)


def coerce_double(value: Column) -> Column:
    """Text or number to double; what cannot be read, and NaN, become null."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number), number)


def clamp(value: Column, low: float, high: float) -> Column:
    """Bound a value on both sides and keep null as null."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def is_finite(value: Column) -> Column:
    """True only for a present, non-NaN, bounded number."""
    number = value.cast("double")
    return F.coalesce(
        ~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))),
        F.lit(False),
    )


def fixed(value: Column, decimals: int) -> Column:
    """Number as text with fixed decimals, rounded on the exact binary value."""
    return F.call_function("format_number", value.cast("double"), F.lit("0." + "0" * decimals))


def ratio_or(numerator: Column, denominator: Column, default: float) -> Column:
    """Quotient, or the default where the denominator is zero."""
    return F.when(denominator != 0, numerator / denominator).otherwise(
        F.when(denominator.isNotNull() & numerator.isNotNull(), F.lit(default))
    )
