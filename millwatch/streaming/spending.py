"""Maintenance cost kept by period and machine, so that expense figures read sums and not every cost row.

Each batch adds its own sums under its number, so a repeated batch replaces itself and the order of batches is of no matter. When
many batches lie behind the last fold, their sums are folded into one table; readers take the fold and the batches behind it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from millwatch.operators.finance import ROWS, row_count
from millwatch.session import exists, folders, remove
from millwatch.streaming.runs import each_batch

PARTS = ("sums", "billed")
#: Rows that a task sums, about. There are more tasks for more rows, so that what a task holds does not grow with the history.
TASK_ROWS = 500_000


def cost_sums(cost: DataFrame) -> DataFrame:
    """Amount and number of cost rows by year, month and machine; of sums of sums, the sums."""
    return cost.groupBy("year", "month", "machine_id").agg(F.sum("amount").cast("decimal(38,2)").alias("amount"), row_count(cost).alias(ROWS))


def billed_tickets(cost: DataFrame) -> DataFrame:
    """Which tickets have cost in a month, each once."""
    return cost.select("year", "month", "ticket_id").distinct()


_FOLD = {"sums": (cost_sums, "machine_id"), "billed": (billed_tickets, "ticket_id")}


def _folded(rows: DataFrame, part: str) -> DataFrame:
    """Kept rows of a part as one table, dealt by machine or ticket; later sums and joins by these find their rows together.

    They are sums of batches already, so no machine or ticket has many."""
    make, key = _FOLD[part]
    return make(rows.repartition(max(1, -(-rows.count() // TASK_ROWS)), key))


def _mark(spark: SparkSession, path: str) -> int:
    return max((n for n in folders(spark, f"{path}/_fold", "upto=") if exists(spark, f"{path}/_fold/upto={n}/_done")), default=-1)


def _paths(spark: SparkSession, path: str, part: str) -> list[str]:
    mark = _mark(spark, path)
    return [f"{path}/_fold/upto={mark}/{part}"] * (mark >= 0) + [f"{path}/batch={n}/{part}" for n in folders(spark, path, "batch=") if n > mark]


def kept_costs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(sums, billed tickets): the first stands for the cost rows in every expense figure, the second in mean repair times."""
    return tuple(_folded(spark.read.parquet(*_paths(spark, path, part)), part) for part in PARTS)


def fold(spark: SparkSession, path: str, upto: int) -> None:
    """Write the sums up to a batch as one table; older folds and the batches in it go, but for the last of each."""
    marks, inside = folders(spark, f"{path}/_fold", "upto="), [n for n in folders(spark, path, "batch=") if n < upto]
    for part, frame in zip(PARTS, kept_costs(spark, path)):
        frame.write.mode("overwrite").parquet(f"{path}/_fold/upto={upto}/{part}")
    spark.range(1).write.mode("overwrite").parquet(f"{path}/_fold/upto={upto}/_done")
    for n in [n for n in marks if n < upto][:-1]:
        remove(spark, f"{path}/_fold/upto={n}")
    for n in inside:
        remove(spark, f"{path}/batch={n}")


def keep_costs(cost: DataFrame, path: str, checkpoint: str, fold_after: int = 64, every: str | None = None) -> StreamingQuery:
    """Add cost rows (year, month, machine_id, ticket_id, amount) as they come."""

    def add(batch: DataFrame, number: int) -> None:
        spark, rows = batch.sparkSession, batch.persist()
        for part in PARTS:
            _FOLD[part][0](rows).write.mode("overwrite").parquet(f"{path}/batch={number}/{part}")
        rows.unpersist()
        mark = _mark(spark, path)
        if mark < number and len([n for n in folders(spark, path, "batch=") if n > mark]) >= fold_after:
            fold(spark, path, number)

    return each_batch(cost, add, checkpoint, every)
