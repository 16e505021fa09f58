"""Bloom filters of keys as rows of bitmaps: made by an aggregate, merged by OR, tested by one equi-join.

A filter has ``parts`` rows of 32,768 bits; a key sets HASHES bits of one part. At about 2,700 keys a part one absent key in thirty
passes. With PARTS parts a filter is 4 MB at most whatever it holds, so it may be broadcast; too many keys only make it let more pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

HASHES, PART_BITS, PARTS = 3, 1 << 15, 1024
BITMAPS = "part int, bits binary"


def part_of(key: str, parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(F.lit("part"), key), F.lit(parts)).cast("int")


def _bit(key: str, i: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(f"bit{i}"), key), F.lit(PART_BITS)).cast("long")


def bitmaps(keys: DataFrame, key: str, *by: str, parts: int = PARTS) -> DataFrame:
    """by, part, bits of the keys; partial bitmaps merge before the shuffle."""
    bits = F.explode(F.array(*[_bit(key, i) for i in range(HASHES)])).alias("bit")
    return keys.select(*by, part_of(key, parts).alias("part"), bits).groupBy(*by, "part").agg(F.bitmap_construct_agg("bit").alias("bits"))


def merged(maps: DataFrame, *by: str) -> DataFrame:
    return maps.groupBy(*by, "part").agg(F.bitmap_or_agg("bits").alias("bits"))


def may_hold(rows: DataFrame, key: str, maps: DataFrame, *by: str, parts: int = PARTS) -> DataFrame:
    """Rows whose key the filter (of their ``by`` columns) lets through: all that were put in, and few others. Null keys do not pass."""
    tested = rows.filter(F.col(key).isNotNull()).withColumn("_part", part_of(key, parts))
    tested = tested.join(maps.withColumnsRenamed({"part": "_part", "bits": "_bits"}), [*by, "_part"])
    for i in range(HASHES):
        byte = F.conv(F.hex(F.substring("_bits", (_bit(key, i) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        tested = tested.filter(F.getbit(byte, (_bit(key, i) % 8).cast("int")) == 1)
    return tested.select(*rows.columns)
