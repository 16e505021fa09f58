"""Arithmetic whose result does not depend on row order or on an engine's rounding rule."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def round_to(value: Column, digits: int) -> Column:
    """Half-up rounding of a double."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / scale


def exact_sum(value: Column, scale: int = 12) -> Column:
    """Sum of doubles taken as decimals, so that partial sums may merge in any order.

    Digits behind ``scale`` are rounded off; the whole part of a value may have 28 - ``scale`` digits.
    """
    return F.sum(value.cast(f"decimal(28,{scale})")).cast("double")


def exact_mean(value: Column, scale: int = 12) -> Column:
    """Mean of doubles taken as decimals; null over no values."""
    count = F.count(value)
    return F.when(count > 0, exact_sum(value, scale) / count.cast("double"))


def uniform(key: Column, salt: str) -> Column:
    """A draw in [0, 1] that is a function of the key alone."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f"|{salt}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967295.0)


MICROS_PER_HOUR = 3600000000.0


def micros_between(start: Column, end: Column) -> Column:
    """Elapsed microseconds, a whole number that may be summed in any order."""
    return F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))


def hours_between(start: Column, end: Column) -> Column:
    """Elapsed hours, exact to the microsecond."""
    return micros_between(start, end) / F.lit(MICROS_PER_HOUR)
