"""Scoring, escalation and de-duplication on streams.

``operators.alerts.threshold_alerts`` is stateless and runs on a stream as it is. Escalation and de-duplication are jobs over batches
(``closing``): their rules are plain DataFrame functions over closed rows, and what comes too late is stored beside the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from millwatch.operators.alerts import first_of_epochs
from millwatch.operators.scoring import score_readings
from millwatch.schemas import ESCALATION_MINUTES
from millwatch.streaming.closing import Batch, Rule, close_in_time


def stream_scores(readings: DataFrame, every: str = "1 minute") -> DataFrame:
    """The newest reading per machine and window, scored when the window closes."""
    newest = (
        readings.groupBy(F.window("timestamp", every).alias("window"), "machine_id")
        .agg(F.max_by(F.struct("reading_id", "timestamp", "temperature", "vibration"), F.struct("timestamp", "reading_id")).alias("_r"))
        .select(F.col("_r.reading_id"), "machine_id", F.col("_r.timestamp"), F.col("_r.temperature"), F.col("_r.vibration"))
    )
    return score_readings(newest)


def dedupe_events(alerts: DataFrame, key: str = "alert_id") -> DataFrame:
    """Ignore an id that has been seen within the watermark."""
    return alerts.dropDuplicatesWithinWatermark([key])


def _minutes(n: int) -> int:
    return n * 60_000_000


def escalation_rule(minutes: int = ESCALATION_MINUTES) -> Rule:
    """An opened alert is judged at its tick, the first whole minute at which it is due. Both kinds of rows are kept as long as an
    alert can need them: an answer counts for alerts that open up to ``minutes + 1`` minutes after it."""
    at, opened = F.unix_micros("event_time"), F.col("kind") == "opened"
    tick = F.ceil((at + _minutes(minutes)) / _minutes(1)).cast("long") * _minutes(1)
    return Rule(
        due=F.when(opened, tick), until=F.when(opened, tick + _minutes(minutes + 1)).otherwise(at + _minutes(2 * minutes + 2)),
        closes=F.when(opened, tick).otherwise(at),
    )


def escalations(batch: Batch, minutes: int = ESCALATION_MINUTES) -> DataFrame:
    """Due alerts without an answer by their tick. An alert opened again within ``minutes + 1`` minutes is the same alert."""
    near = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes + 1))
    opened = batch.due.groupBy("alert_id", "event_time", "due").agg(F.min("machine_id").alias("machine_id"))
    others = batch.live.select(F.col("alert_id").alias("_id"), F.col("event_time").alias("_at"), "kind")
    answers, earlier = others.filter("kind = 'answered'"), others.filter("kind = 'opened'")
    tick = F.timestamp_micros("due")
    same, since = F.col("alert_id") == F.col("_id"), F.col("_at") >= F.col("event_time") - near
    left = opened.join(answers, same & since & (F.col("_at") <= tick), "left_anti").join(earlier, same & since & (F.col("_at") < F.col("event_time")), "left_anti")
    return left.select(
        "alert_id", "machine_id", F.col("event_time").alias("triggered_at"),
        F.lit("escalated").alias("status"), F.lit(True).alias("auto_escalated"), tick.alias("escalated_at"),
    )


def escalate_stream(events: DataFrame, out: str, checkpoint: str, minutes: int = ESCALATION_MINUTES, every: str | None = None) -> StreamingQuery:
    """Escalations of ``events(alert_id, machine_id, kind, event_time)`` with kind ``opened`` or ``answered``, under ``{out}/escalated``:
    an alert without an answer by its tick is escalated when the mark gets there.

    Ids keep the types they come with; a null id is no alert. An answer whose time the mark had passed when it came is in
    ``{out}/late``, its alert stays escalated.
    """

    def shrink(rows: DataFrame) -> DataFrame:
        rows = rows.filter("alert_id IS NOT NULL AND kind IN ('opened', 'answered')")
        return rows.groupBy("alert_id", "kind", "event_time", "due", "until").agg(F.min("machine_id").alias("machine_id"))

    def judge(batch: Batch) -> None:
        escalations(batch, minutes).write.mode("overwrite").parquet(f"{out}/escalated/batch={batch.number}")

    return close_in_time(events, escalation_rule(minutes), shrink, judge, out, checkpoint, every=every)


def minute_rule() -> Rule:
    """Rows are taken when their minute is over."""
    end = (F.floor(F.unix_micros("event_time") / _minutes(1)) + 1).cast("long") * _minutes(1)
    return Rule(end, end, end)


def instants(events: DataFrame) -> DataFrame:
    """One row per machine and instant of ``events(machine_id, side, alert_id, severity, event_time)``: whether there was an answer, and the
    first candidate by its id."""
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("alert_id", "severity")}
    candidate = F.when(F.col("side") == 1, F.struct(text["alert_id"].alias("alert_id"), text["severity"].alias("severity")))
    return events.filter("machine_id IS NOT NULL").groupBy("machine_id", "event_time", "due", "until").agg(
        F.max(F.when(F.col("side") == 0, 1).otherwise(0)).alias("answered"), F.min(candidate).alias("first"),
    )


def opened_alerts(line: DataFrame, still_open: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(alerts that open, machines open afterwards) of closed ``instants``; several rows of an instant are one.

    ``still_open(machine_id)`` are the machines whose alert was open before. The passes run in slots of a minute, so that no task
    needs all rows of a machine.
    """
    line = line.groupBy("machine_id", "event_time").agg(F.max("answered").alias("answered"), F.min("first").alias("first"))
    line = line.withColumn("candidate", F.col("first").isNotNull())
    firsts = first_of_epochs(line, "machine_id", "event_time", "answered", "candidate", levels=("minute",))
    busy = still_open.select("machine_id", F.lit(0).alias("_epoch"))
    starts = firsts.join(busy, ["machine_id", "_epoch"], "left_anti").select("machine_id", "event_time")
    opened = line.join(starts, ["machine_id", "event_time"]).select("first.alert_id", "machine_id", F.col("event_time").alias("triggered_at"), "first.severity")
    last = line.groupBy("machine_id").agg(
        F.max(F.when(F.col("candidate"), F.col("event_time"))).alias("_candidate"), F.max(F.when(F.col("answered") == 1, F.col("event_time"))).alias("_answer")
    )
    now = last.filter("_candidate IS NOT NULL AND (_answer IS NULL OR _candidate >= _answer)").select("machine_id")
    unheard = still_open.join(last.filter("_answer IS NOT NULL"), "machine_id", "left_anti")
    return opened, now.unionByName(unheard).distinct()


def dedupe_stream(events: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """One active alert per machine over ``events(machine_id, side, alert_id, severity, event_time)``, where side 0 is an answer
    and side 1 a candidate, under ``{out}/opened``. Rows are taken in event-time order, minute by minute as the mark passes.

    The machine id keeps the type it comes with; rows without one are no alert. ``{out}/open`` holds the machines whose alert is open,
    in two slots that batches write in turn. A row whose minute was closed when it came is in ``{out}/late``.
    """
    machine = events.schema["machine_id"].dataType.simpleString()

    def judge(batch: Batch) -> None:
        spark, slot = batch.due.sparkSession, batch.number % 2
        shape = f"machine_id {machine}"
        before = spark.read.schema(shape).parquet(f"{out}/open/slot={1 - slot}") if batch.number else spark.createDataFrame([], shape)
        opened, still = opened_alerts(batch.due, before)
        opened.write.mode("overwrite").parquet(f"{out}/opened/batch={batch.number}")
        still.write.mode("overwrite").parquet(f"{out}/open/slot={slot}")

    return close_in_time(events, minute_rule(), instants, judge, out, checkpoint, every=every)
