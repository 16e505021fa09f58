"""Event-time jobs whose rows wait in files: a mark runs behind the newest time seen, and what lies behind it is judged.

Each batch writes only what it brings, under its own number. A waiting row is written once and read while the mark has not
passed the end of its use. Rows that come after their time was closed are not lost: they go to ``late``. Nothing is kept in
executors, so a repeated batch finds what it found before and replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from millwatch.schemas import WATERMARK
from millwatch.session import remove
from millwatch.streaming.runs import each_batch

MARKS = "mark bigint, live array<struct<batch: bigint, last: bigint>>"
LONG_AGO = -(1 << 62)


class Rule(NamedTuple):
    """Microseconds of a row: when it is judged (null: never by itself), until when others need it, when it is late."""

    due: Column
    until: Column
    closes: Column


class Batch(NamedTuple):
    """What a batch has to judge: rows due now, and all that are still in use (those included)."""

    due: DataFrame
    live: DataFrame
    number: int


def close_in_time(
    events: DataFrame, rule: Rule, shrink: Callable[[DataFrame], DataFrame], judge: Callable[[Batch], None],
    out: str, checkpoint: str, delay: str = WATERMARK, every: str | None = None,
) -> StreamingQuery:
    """Run ``judge`` once a batch over the rows of ``events`` (with ``event_time``) whose due time the mark has passed.

    The mark is the newest event time so far less ``delay``. ``shrink`` reduces a batch's own rows before they wait; it must keep
    the columns of the rule. A row is late if its ``closes`` lies at or behind the mark of the batch before, or has no time;
    ``late`` has it as it came, with the mark and the batch.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _marks(spark, out, number - 1)
        passed, logged = (before["mark"], before["live"]) if before else (LONG_AGO, [])
        rows = batch.withColumns({"due": rule.due, "until": rule.until, "closes": rule.closes}).persist()
        newest = rows.agg(F.expr(f"unix_micros(max(event_time) - INTERVAL {delay})")).first()[0]
        mark = max(passed, newest if newest is not None else passed)
        in_time = F.coalesce(F.col("closes") > passed, F.lit(False))
        late = rows.filter(~in_time).drop("due", "until", "closes")
        late.withColumns({"mark": F.timestamp_micros(F.lit(passed)) if before else F.lit(None).cast("timestamp")}).write.mode("overwrite").parquet(f"{out}/late/batch={number}")
        fresh = shrink(rows.filter(in_time)).persist()
        live = fresh
        if logged:
            live = live.unionByName(waiting(spark, out, fresh, [x["batch"] for x in logged]).filter(F.col("until") > passed))
        judge(Batch(live.filter((F.col("due") > passed) & (F.col("due") <= mark)), live, number))
        kept = fresh.filter(F.col("until") > mark).sortWithinPartitions("until")
        kept.write.mode("overwrite").parquet(f"{out}/waiting/batch={number}")
        last = waiting(spark, out, fresh, [number]).agg(F.max("until")).first()[0]
        still = [(x["batch"], x["last"]) for x in logged if x["last"] > mark] + ([(number, last)] if last is not None else [])
        spark.createDataFrame([(mark, still)], MARKS).coalesce(1).write.mode("overwrite").parquet(f"{out}/marks/batch={number}")
        # a repeated batch reads what the one before left, so only what that one no longer named goes
        older = _marks(spark, out, number - 2) if number > 1 else None
        for x in (older["live"] if older else []):
            if x["batch"] not in {y["batch"] for y in logged}:
                remove(spark, f"{out}/waiting/batch={x['batch']}")
        if number > 2:
            remove(spark, f"{out}/marks/batch={number - 3}")
        for frame in (fresh, rows):
            frame.unpersist()

    return each_batch(events, run, checkpoint, every)


def waiting(spark: SparkSession, out: str, like: DataFrame, batches: list[int]) -> DataFrame:
    """Waiting rows of some batches; the files of others are not opened."""
    return spark.read.schema(like.schema).parquet(*[f"{out}/waiting/batch={b}" for b in batches])


def late_rows(spark: SparkSession, out: str) -> DataFrame:
    """Rows that came after their time was closed, with the mark they missed."""
    return spark.read.option("basePath", f"{out}/late").parquet(f"{out}/late")


def results(spark: SparkSession, out: str, name: str) -> DataFrame:
    return spark.read.option("basePath", f"{out}/{name}").parquet(f"{out}/{name}").drop("batch")


def _marks(spark: SparkSession, out: str, number: int):
    return spark.read.schema(MARKS).parquet(f"{out}/marks/batch={number}").first() if number >= 0 else None

