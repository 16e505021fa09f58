"""The ingestion job: checked readings to storage, alarms and rejects beside them, per micro-batch."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from millwatch.operators.alerts import alarm_payload, alarmed_machines, threshold_alerts
from millwatch.operators.events import to_event_json
from millwatch.operators.validate import SPECS, parse_json, with_defaults, with_problems
from millwatch.schemas import INGEST_LIMITS, SENSORS
from millwatch.streaming.runs import each_batch
from millwatch.streaming.seen import SeenIds, stored_ids

FIELDS = ["reading_id", "machine_id", "timestamp", *SENSORS]


def ingest(
    raw: DataFrame, machines: DataFrame, out: str, checkpoint: str,
    limits: dict[str, float] = INGEST_LIMITS, every: str | None = None,
):
    """Store JSON readings of ``raw(value)`` that are valid and name a known machine.

    A reading without time takes the ``arrived`` column of ``raw``; without that column it is
    rejected, for the clock would give a repeated batch other results. An absent id is made from the
    content.

    A reading whose id is stored for its day already, or comes twice in a batch, is ignored. Readings lie in a folder per day and
    batch; a batch opens the folders of its own days only, and of these only if the days' filters (``seen``) know some of its ids.

    Each batch writes ``readings``, ``alerts``, ``rejected``, ``machine_changes`` (what the alarms set on their machines)
    and ``events`` (one ``alert_new`` envelope per alarm) under its own number, so that a repeated batch replaces itself.
    """
    known = machines.select(F.col("machine_id").cast("string").alias("machine_id"), "name")

    def store(batch: DataFrame, batch_id: int) -> None:
        spec = replace(SPECS["sensor_readings"], required=["timestamp", *SPECS["sensor_readings"].required])
        arrived = F.col("arrived") if "arrived" in batch.columns else F.lit(None)
        checked = with_problems(with_defaults(parse_json(batch, "value", spec, FIELDS), arrived), spec)
        checked = checked.join(known.select("machine_id", F.lit(True).alias("_known")), "machine_id", "left")
        orphan = F.col("machine_id").isNotNull() & F.col("_known").isNull()
        checked = checked.withColumn(
            "problems", F.when(orphan, F.array_append("problems", F.lit("machine_id: not found"))).otherwise(F.col("problems"))
        )
        checked = checked.drop("_known").persist()
        good = F.size("problems") == 0
        typed = [F.col(c).try_cast(spec.types[c]).alias(c) if c in spec.types else F.col(c) for c in FIELDS]
        fresh = checked.filter(good).select(*typed).withColumn("date", F.to_date("timestamp")).dropDuplicates(["date", "reading_id"])
        fresh, spark = fresh.persist(), batch.sparkSession
        days = [str(r["date"]) for r in fresh.select("date").distinct().collect()]
        filters = SeenIds(spark, f"{out}/seen")
        known_ids = filters.known(fresh.select("date", "reading_id"), "reading_id", days).persist()
        arrived_ids = fresh
        if not known_ids.isEmpty():
            again = known_ids.join(stored_ids(spark, f"{out}/readings", days, batch_id), ["date", "reading_id"], "left_semi")
            fresh = fresh.join(again, ["date", "reading_id"], "left_anti").persist()
        write = lambda df, part: df.write.mode("overwrite").parquet(f"{out}/{part}/batch={batch_id}")
        by_day = fresh.withColumn("batch", F.lit(batch_id)).hint("rebalance", F.col("date")).write.mode("overwrite")
        by_day.option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch").parquet(f"{out}/readings")
        filters.add(fresh.select("date", "reading_id"), "reading_id", days, batch_id)
        write(checked.filter(~good).select("value", "problems"), "rejected")
        alarms = threshold_alerts(fresh.drop("date"), known, limits).persist()
        write(alarms, "alerts")
        write(alarmed_machines(alarms), "machine_changes")
        write(to_event_json(alarm_payload(alarms), "alert_new", "triggered_at"), "events")
        for frame in (alarms, fresh, known_ids, arrived_ids, checked):
            frame.unpersist()

    return each_batch(raw, store, checkpoint, every)


def read_out(spark: SparkSession, out: str, part: str) -> DataFrame:
    return spark.read.parquet(f"{out}/{part}")
