"""Instants and time-ordered passes that do not need a whole key in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# Time slots, finest first: a task sees the instants of one key and hour, then the hours of one key.
# A feed with more than some ten million instants per key and hour wants ("minute", "day").
LEVELS = ("hour",)


def moment(as_of: str, df: DataFrame, like: str) -> Column:
    """A given instant in the type of the frame's own time column."""
    return F.lit(as_of).cast(df.schema[like].dataType)


def carry_forward(
    df: DataFrame, key: str, time: str, value: str, needed: str, levels: Sequence[str] = LEVELS
) -> DataFrame:
    """The ``needed`` rows, each with the last ``value`` up to it that is not null, per key.

    One row per key and time is expected, which bounds a slot by its length; other columns are not kept.
    """
    return _pass(
        df, key, time, value, needed, levels, 0,
        over=lambda v: F.last(v, ignorenulls=True),
        reduce=lambda v, t: F.max_by(v, F.when(F.col(v).isNotNull(), F.col(t))),
        combine=F.coalesce,
    )


def running_sum(
    df: DataFrame, key: str, time: str, value: str, needed: str, levels: Sequence[str] = LEVELS
) -> DataFrame:
    """The ``needed`` rows, each with the sum of ``value`` up to it, likewise."""
    return _pass(
        df, key, time, value, needed, levels, 0,
        over=F.sum, reduce=lambda v, t: F.sum(v),
        combine=lambda inside, start: F.coalesce(inside, F.lit(0)) + F.coalesce(start, F.lit(0)),
    )


def _pass(df, key, time, value, needed, levels, through, over, reduce, combine) -> DataFrame:
    """A running aggregate, made inside time slots and completed by what each slot starts with.

    What a slot starts with is the same pass over one row per slot, in coarser slots, up to the slot
    before. ``through`` is 0 to count a row itself and -1 to stop before it. Both readers of ``df``
    take the same columns in the same order and the same rows, so that they share its last shuffle.
    """
    rows = (Window.unboundedPreceding, through)
    if not levels:
        whole = Window.partitionBy(key).orderBy(time).rowsBetween(*rows)
        return df.select(key, time, needed, value).withColumn(value, over(value).over(whole)).filter(needed)
    slot, start, wanted = (f"_{name}{len(levels)}" for name in ("slot", "start", "wanted"))
    slotted = df.select(key, time, needed, value).withColumn(slot, F.date_trunc(levels[0], F.col(time)))
    slotted = slotted.filter(F.col(key).isNotNull() & F.col(slot).isNotNull())
    ends = slotted.groupBy(key, slot).agg(reduce(value, time).alias(value), F.max(needed).alias(wanted))
    starts = (
        _pass(ends, key, slot, value, wanted, levels[1:], -1, over, reduce, combine)
        .withColumnRenamed(value, start).drop(wanted)
    )
    inside = Window.partitionBy(key, slot).orderBy(time).rowsBetween(*rows)
    return (
        slotted.withColumn(value, over(value).over(inside)).filter(needed)
        .join(starts, [key, slot])
        .withColumn(value, combine(F.col(value), F.col(start)))
        .drop(slot, start)
    )
