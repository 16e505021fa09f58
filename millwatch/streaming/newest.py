"""The newest rows of every machine, kept as a table, so that scoring, snapshot and detail never read the history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from millwatch.operators.assets import latest, newest_n
from millwatch.streaming.runs import each_batch

SLOTS = 2


def newest_rows(rows: DataFrame, n: int = 1, row_id: str = "reading_id") -> DataFrame:
    """At most n rows per machine, the newest by time, then id. A row that is there twice counts once."""
    if n == 1:
        return latest(rows, "machine_id", "timestamp", row_id)
    return newest_n(rows.dropDuplicates(["machine_id", "timestamp", row_id]), "machine_id", "timestamp", row_id, n).drop("rank")


def rebuild_newest(rows: DataFrame, path: str, n: int = 1, row_id: str = "reading_id") -> None:
    """Start the table from the stored history (or from no rows); the only full scan."""
    newest = newest_rows(rows, n, row_id)
    newest.write.mode("overwrite").parquet(f"{path}/slot=0")
    for slot in range(1, SLOTS):
        newest.limit(0).write.mode("overwrite").parquet(f"{path}/slot={slot}")


def newest_kept(spark: SparkSession, path: str, schema: StructType, n: int = 1, row_id: str = "reading_id") -> DataFrame:
    """n rows per machine at most. The slot written last holds all that counts of the other, so the newest of both are right."""
    return newest_rows(spark.read.schema(schema).parquet(*[f"{path}/slot={s}" for s in range(SLOTS)]), n, row_id)


def keep_newest(
    rows: DataFrame, path: str, checkpoint: str, every: str | None = None, n: int = 1, row_id: str = "reading_id"
) -> StreamingQuery:
    """Merge each batch's own newest rows into the table: a batch costs what it brings and n rows per machine.

    Batches write the slots in turn and read the other one, so a batch that is repeated finds what it found before. Readings
    and predictions are kept alike; which is told by their id.
    """
    schema = rows.schema

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark, slot = batch.sparkSession, (batch_id + 1) % SLOTS
        before = spark.read.schema(schema).parquet(f"{path}/slot={(slot + 1) % SLOTS}")
        newest_rows(before.unionByName(batch), n, row_id).write.mode("overwrite").parquet(f"{path}/slot={slot}")

    return each_batch(rows, merge, checkpoint, every)
