"""Alert listings, alarms, escalation, de-duplication and responses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from millwatch.functions import gauges
from millwatch.functions.numbers import hours_between
from millwatch.operators import bitfilter
from millwatch.operators.changes import SET, apply_changes
from millwatch.operators.paging import names_of_page
from millwatch.operators.times import LEVELS, carry_forward, moment, running_sum
from millwatch.schemas import ACTIVE_ALERT, ESCALATION_MINUTES, INGEST_LIMITS


def actionable(alerts: DataFrame) -> DataFrame:
    """Alerts that still wait for an answer."""
    return alerts.filter(F.col("status").isin(ACTIVE_ALERT))


def list_alerts(
    alerts: DataFrame, machines: DataFrame, user_id=None, role: str | None = None, *,
    status: str | None = None, severity: str | None = None, machine_id=None, alert_id=None,
) -> DataFrame:
    """Alerts a user may see; an operator sees those of the assigned machines. ``active`` is a status
    that stands for pending and escalated."""
    shown = alerts
    if status == "active":
        shown = actionable(shown)
    elif status:
        shown = shown.filter(F.col("status") == status)
    for column, wanted in (("severity", severity), ("machine_id", machine_id), ("alert_id", alert_id)):
        if wanted is not None:
            shown = shown.filter(F.col(column) == wanted)
    if role == "operator":
        own = machines.filter(F.col("assigned_operator_id") == user_id).select("machine_id")
        shown = shown.join(own, "machine_id", "left_semi")
    return shown


def newest_alerts() -> list:
    """Sort order of alert lists."""
    return [F.col("triggered_at").desc(), F.col("alert_id").desc()]


def alerts_with_machine(alerts: DataFrame, machines: DataFrame) -> DataFrame:
    names = machines.select("machine_id", F.col("name").alias("machine_name"))
    return alerts.join(names, "machine_id", "left").withColumn(
        "machine_name", F.coalesce("machine_name", F.lit("Unknown"))
    )


def alerts_with_prediction(alerts: DataFrame, predictions: DataFrame) -> DataFrame:
    """Each alert with the prediction in force when it was triggered (at or before), or none.

    The pass over time carries ids only, one row per machine and instant; the predictions are looked
    up by their id at the end, where no key is hot. A filter of the chosen ids, of 4 MB at most, goes to
    the predictions first, so that the others' columns never leave their task.
    """
    line = (
        predictions.select("machine_id", F.col("timestamp").alias("_time"), F.col("prediction_id").alias("_id"), F.lit(False).alias("_asked"))
        .unionByName(
            alerts.select("machine_id", F.col("triggered_at").alias("_time")).distinct().withColumns(
                {"_id": F.lit(None).cast(predictions.schema["prediction_id"].dataType), "_asked": F.lit(True)}
            )
        )
        .groupBy("machine_id", "_time").agg(F.max("_id").alias("_id"), F.max("_asked").alias("_asked"))
    )
    in_force = carry_forward(line, "machine_id", "_time", "_id", "_asked").select(
        "machine_id", F.col("_time").alias("triggered_at"), "_id"
    )
    chosen = bitfilter.may_hold(predictions, "prediction_id", F.broadcast(bitfilter.bitmaps(in_force, "_id")))
    found = chosen.select(F.col("prediction_id").alias("_id"), F.struct(*predictions.columns).alias("prediction"))
    return alerts.join(in_force, ["machine_id", "triggered_at"], "left").join(found, "_id", "left").drop("_id")


def mtbf(alerts: DataFrame) -> DataFrame:
    """Mean hours between consecutive critical alerts per machine.

    The gaps of a machine add up to its span, so first, last and count are enough.
    """
    spans = (
        alerts.filter(F.col("severity") == "critical").groupBy("machine_id")
        .agg(F.min("triggered_at").alias("_first"), F.max("triggered_at").alias("_last"), F.count("*").alias("failures"))
    )
    return spans.select(
        "machine_id", "failures",
        F.when(F.col("failures") > 1, hours_between(F.col("_first"), F.col("_last")) / (F.col("failures") - 1)).alias("mtbf_hours"),
    )


def fleet_mtbf(alerts: DataFrame) -> DataFrame:
    """Mean over all gaps of all machines."""
    spans = (
        alerts.filter(F.col("severity") == "critical").groupBy("machine_id")
        .agg(F.min("triggered_at").alias("_first"), F.max("triggered_at").alias("_last"), F.count("*").alias("_n"))
        .select((F.unix_micros(F.col("_last").cast("timestamp")) - F.unix_micros(F.col("_first").cast("timestamp"))).alias("_span"), (F.col("_n") - 1).alias("_gaps"))
    )
    gaps = F.sum("_gaps")
    return spans.agg(
        F.coalesce(gaps, F.lit(0)).alias("gaps"),
        F.when(gaps > 0, F.sum("_span") / F.lit(3600000000.0) / gaps).alias("mtbf_hours"),
    )


def critical_banner(alerts: DataFrame, machines: DataFrame, shown: int = 2) -> DataFrame:
    """One row: how many critical alerts there are, the newest few, and how many are not shown."""
    critical = alerts.filter(F.col("severity") == "critical")
    newest = critical.orderBy(*newest_alerts()).limit(shown)
    newest = alerts_with_machine(newest, names_of_page(newest, machines, "machine_id"))
    total = critical.agg(F.count("*")).scalar()
    return (
        newest.agg(
            F.reverse(F.sort_array(F.collect_list(F.struct("triggered_at", "alert_id", "machine_id", "machine_name")))).alias("newest")
        )
        .withColumn("critical_alerts", total)
        .withColumn("more", F.greatest(F.col("critical_alerts") - shown, F.lit(0)))
    )


def threshold_alerts(readings: DataFrame, machines: DataFrame, limits: dict[str, float] = INGEST_LIMITS) -> DataFrame:
    """An alarm for every reading of a known machine that is over a limit, batch or stream.

    ``alert_rows``, ``alarmed_machines`` and ``alarm_payload`` give its three results.
    """
    temperature, vibration = F.col("temperature"), F.col("vibration")
    names = machines.select("machine_id", F.col("name").alias("machine_name"))
    return (
        readings.filter(gauges.breaches(temperature, vibration, limits))
        .join(names, "machine_id")
        .select(
            F.md5(F.concat(F.col("reading_id").cast("string"), F.lit("|alarm"))).alias("alert_id"),
            "machine_id", F.col("timestamp").alias("triggered_at"),
            F.lit("critical").alias("severity"), F.lit("pending").alias("status"),
            F.lit(False).alias("auto_escalated"),
            gauges.breach_type(temperature, limits).alias("type"),
            gauges.breach_message(F.col("machine_name"), temperature, vibration).alias("message"),
        )
    )


def alert_rows(alarms: DataFrame) -> DataFrame:
    return alarms.drop("type", "message")


def alarmed_machines(alarms: DataFrame) -> DataFrame:
    """The change an alarm makes to its machine, once per machine."""
    return alarms.groupBy("machine_id").agg(
        F.lit("critical").alias("risk_level"), F.lit("warning").alias("status"),
        F.max("triggered_at").alias("last_updated"),
    )


def apply_alarms(machines: DataFrame, alarms: DataFrame) -> DataFrame:
    """Machines after their alarms."""
    change = alarmed_machines(alarms)
    stated = F.array(*[F.lit(c) for c in change.columns if c != "machine_id"])
    return apply_changes(machines, change.withColumns({"seq": F.lit(0), SET: stated}), "machine_id")


def alarm_payload(alarms: DataFrame) -> DataFrame:
    return alarms.select("alert_id", "machine_id", "type", "severity", "status", "message", "triggered_at")


def escalation_tick(triggered_at, minutes: int = ESCALATION_MINUTES):
    """First whole minute at which the alert is due."""
    due = triggered_at + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
    whole = F.date_trunc("minute", due).cast("timestamp")
    exact = due.cast("timestamp")
    return F.when(whole == exact, whole).otherwise(whole + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(1)))


def escalate(alerts: DataFrame, as_of: str, minutes: int = ESCALATION_MINUTES) -> DataFrame:
    """Alerts after the every-minute check has run up to ``as_of``: due pending ones are escalated."""
    time_type = alerts.schema["triggered_at"].dataType
    now = moment(as_of, alerts, "triggered_at")
    tick = escalation_tick(F.col("triggered_at"), minutes).cast(time_type)
    due = (F.col("status") == "pending") & (tick <= now)
    old_flag = F.col("auto_escalated") if "auto_escalated" in alerts.columns else F.lit(False)
    old_time = F.col("escalated_at") if "escalated_at" in alerts.columns else F.lit(None).cast(time_type)
    return alerts.withColumns(
        {
            "status": F.when(due, "escalated").otherwise(F.col("status")),
            "auto_escalated": F.when(due, True).otherwise(old_flag),
            "escalated_at": F.when(due, tick).otherwise(old_time),
        }
    )


def first_of_epochs(
    line: DataFrame, key: str, time: str, answered: str, candidate: str, levels: Sequence[str] = LEVELS
) -> DataFrame:
    """key, _epoch and the time of its first candidate; ``answered`` (0 or 1) of a key's instants number its epochs from 0."""
    return (
        running_sum(line, key, time, answered, candidate, levels).withColumnRenamed(answered, "_epoch")
        .groupBy(key, "_epoch").agg(F.min(time).alias(time))
    )


def dedupe_alerts(candidates: DataFrame, responses: DataFrame) -> DataFrame:
    """One active alert per machine: a candidate opens only if none has since the last response.

    The instants with a response so far number the epochs of a machine; the first candidate of an
    epoch stays. A response comes before a candidate of the same instant. The pass carries one row
    per machine and instant; the candidates of the chosen instants are then looked up.
    """
    line = (
        candidates.select("machine_id", F.col("triggered_at").alias("_time"), F.lit(0).alias("_epoch"), F.lit(True).alias("_candidate"))
        .unionByName(
            responses.select("machine_id", F.col("responded_at").alias("_time"), F.lit(1).alias("_epoch"), F.lit(False).alias("_candidate"))
        )
        .groupBy("machine_id", "_time").agg(F.max("_epoch").alias("_epoch"), F.max("_candidate").alias("_candidate"))
    )
    opened = first_of_epochs(line, "machine_id", "_time", "_epoch", "_candidate").select("machine_id", F.col("_time").alias("triggered_at"))
    return (
        candidates.join(opened, ["machine_id", "triggered_at"], "left_semi")
        .groupBy("machine_id", "triggered_at")
        .agg(F.min_by(F.struct(*candidates.columns), F.col("alert_id").cast("string")).alias("_row"))
        .select("_row.*")
    )


def respond_alerts(alerts: DataFrame, responses: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Answer alerts: ``responses(alert_id, seq, response, operator_id, description, responded_at)``.

    The first answer to an alert that waits for one is taken: it acknowledges the alert, and a
    ``reported`` one opens a ticket. Gives (alerts, rejected answers with a reason, new tickets).
    """
    first = responses.groupBy("alert_id").agg(F.min("seq").alias("_seq"), F.min_by("response", "seq").alias("_response"))
    waiting = F.col("status").isin(ACTIVE_ALERT)
    answered = alerts.join(first, "alert_id", "left")
    taken = waiting & F.col("_seq").isNotNull()
    old = F.col("operator_response") if "operator_response" in alerts.columns else F.lit(None).cast("string")
    updated = answered.withColumns(
        {
            "operator_response": F.when(taken, F.col("_response")).otherwise(old),
            "status": F.when(taken, "acknowledged").otherwise(F.col("status")),
        }
    ).drop("_seq", "_response")
    checked = responses.join(
        answered.select("alert_id", F.col("machine_id").alias("_machine"), "_seq", waiting.alias("_waiting")), "alert_id", "left"
    )
    reason = F.when(F.col("_waiting").isNull(), "alert not found").when(
        ~F.col("_waiting") | (F.col("seq") != F.col("_seq")), "alert not actionable"
    )
    checked = checked.withColumn("reason", reason)
    rejected = checked.filter(F.col("reason").isNotNull()).drop("_machine", "_seq", "_waiting")
    tickets = checked.filter(F.col("reason").isNull() & (F.col("response") == "reported")).select(
        F.md5(F.concat(F.col("alert_id").cast("string"), F.lit("|ticket"))).alias("ticket_id"),
        F.col("_machine").alias("machine_id"), "alert_id", "operator_id", F.lit("open").alias("status"),
        "description", F.lit(False).alias("escalated"), F.col("responded_at").alias("created_at"),
    )
    return updated, rejected, tickets
