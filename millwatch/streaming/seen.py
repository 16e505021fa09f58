"""Which ids a day has stored already: a Bloom filter per day, kept as bitmaps, and an exact look-up of what it lets through.

Each batch adds its own bitmaps (``operators.bitfilter``) under its number; they are merged by OR when read, and into one file when
a day has many. An id that the filter does not know is new; the others (repeats, and few false ones) are compared with the ids
stored for their day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millwatch.operators import bitfilter
from millwatch.session import exists, folders, remove


class SeenIds:
    """Filters below ``{folder}/date=<day>/batch=<n>``. ``parts`` bounds a day's size: about 2,700 ids a part give one false answer in thirty."""

    def __init__(self, spark: SparkSession, folder: str, parts: int = 1024, merge_from: int = 48):
        self.spark, self.folder, self.parts, self.merge_from = spark, folder, parts, merge_from

    def add(self, ids: DataFrame, key: str, days: list[str], batch: int) -> None:
        """Note the ids of ``ids(date, key)``, all of ``days``. Adding them again changes nothing."""
        maps = bitfilter.bitmaps(ids, key, "date", parts=self.parts)
        for_days = maps.withColumn("batch", F.lit(batch)).hint("rebalance", F.col("date"))
        for_days.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch").parquet(self.folder)
        for day in days:
            self._merge(day, batch)

    def _merge(self, day: str, batch: int) -> None:
        """One file for a day that has many. A batch that runs again reads the files it has left; to know an id twice is harmless."""
        held = folders(self.spark, f"{self.folder}/date={day}", "batch=")
        if len(held) < self.merge_from:
            return
        paths = [f"{self.folder}/date={day}/batch={n}" for n in held]
        bitfilter.merged(self.spark.read.schema(bitfilter.BITMAPS).parquet(*paths)).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/date={day}/batch=-{batch + 1}")
        for path in paths:
            remove(self.spark, path)

    def known(self, ids: DataFrame, key: str, days: list[str]) -> DataFrame:
        """Rows of ``ids(date, key, ...)`` that the filters of ``days`` let through: all that were added, and few others."""
        paths = [p for p in (f"{self.folder}/date={day}" for day in days) if exists(self.spark, p)]
        if not paths:
            return ids.limit(0)
        maps = self.spark.read.schema(f"{bitfilter.BITMAPS}, date date").option("basePath", self.folder).parquet(*paths)
        return bitfilter.may_hold(ids, key, bitfilter.merged(maps, "date"), "date", parts=self.parts)


def stored_ids(spark: SparkSession, readings: str, days: list[str], before: int) -> DataFrame:
    """Ids and days stored by earlier batches; only the folders of these days are opened."""
    paths = [p for p in (f"{readings}/date={day}" for day in days) if exists(spark, p)]
    if not paths:
        return spark.createDataFrame([], "reading_id string, date date")
    held = spark.read.schema("reading_id string, date date, batch long").option("basePath", readings).parquet(*paths)
    return held.filter(F.col("batch") < before).select("reading_id", "date")
