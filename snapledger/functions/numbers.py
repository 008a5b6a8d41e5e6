"""Numeric column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EXACT_DOUBLE = float(2**53)


def round_half_away(value: Column, digits: int = 0) -> Column:
    """Round the double as stored, half away from zero.

    `F.round` rounds the shortest decimal text of a double, so 1.005 becomes 1.01; the stored
    value lies below that and this expression gives 1.0. Values beyond 2^53 have no fraction.
    """
    scale = float(10**digits)
    value = value.cast("double")
    scaled = F.abs(value) * F.lit(scale)
    rounded = F.signum(value) * F.floor(scaled + F.lit(0.5)) / F.lit(scale)
    return F.when(scaled < F.lit(_EXACT_DOUBLE), rounded).otherwise(value)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division; NULL where the denominator is 0 or NULL, also under ANSI."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def per_90(amount: Column, minutes: Column) -> Column:
    """Rate per 90 minutes."""
    return ratio(amount, ratio(minutes, F.lit(90.0)))


def price_in_millions(tenths: Column) -> Column:
    """Price stored in tenths of a million, as millions with one decimal."""
    return round_half_away(tenths.cast("double") / F.lit(10.0), 1)
