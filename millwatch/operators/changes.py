"""Partial updates: a change set is a frame, applying it gives the next snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

SET = "_set"


def apply_changes(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Base rows after ``changes(key, seq, _set, ...columns)``, taken in order of ``seq``.

    ``_set`` names the columns a change states, so a stated null differs from a column left out.
    The last statement per key and column wins; changes of unknown keys have no effect. The changes
    of a key merge before the shuffle, however many there are.
    """
    columns = [c for c in changes.columns if c in base.columns and c != key]
    if not columns:
        return base
    last = changes.groupBy(key).agg(
        *[
            F.max_by(
                F.struct(F.col(c).cast(base.schema[c].dataType).alias("v")),
                F.when(F.array_contains(SET, c), F.col("seq")),
            ).alias(f"_new_{c}")
            for c in columns
        ]
    )
    merged = base.join(last, key, "left")
    return merged.select(
        *[
            (F.when(F.col(f"_new_{c}").isNotNull(), F.col(f"_new_{c}.v")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c))
            for c in base.columns
        ]
    )


def known_changes(changes: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Changes whose key exists, with the other columns of ``keys``."""
    return changes.join(keys, key)


def with_set_mask(changes: DataFrame, columns: list[str]) -> DataFrame:
    """Mask for change sets in which a null means "not stated"."""
    stated = F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in columns])
    return changes.withColumn(SET, F.array_compact(stated))
