"""Machines with their readings and predictions: newest rows, detail views, risk and impact."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from millwatch.functions import gauges, health, texts
from millwatch.functions.numbers import exact_mean, exact_sum, round_to
from millwatch.operators.access import active_users
from millwatch.operators.alerts import actionable
from millwatch.operators.tickets import with_open_ticket_count
from millwatch.schemas import GAUGE_LIMITS, SENSORS

RISKY = ["high", "critical"]


def latest(df: DataFrame, key: str, time: str, row_id: str) -> DataFrame:
    """Newest row per key; ties go to the larger id. Partial results merge before the shuffle.

    All columns travel, so select what is needed first.
    """
    rest = [c for c in df.columns if c != key]
    newest = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(time, row_id)).alias("_row"))
    return newest.select(*[F.col(f"_row.{c}").alias(c) if c != key else F.col(key) for c in df.columns])


def latest_reading(readings: DataFrame, *columns: str) -> DataFrame:
    """Newest reading per machine, with the given sensors or all."""
    if columns:
        readings = readings.select("reading_id", "machine_id", "timestamp", *columns)
    return latest(readings, "machine_id", "timestamp", "reading_id")


def latest_prediction(predictions: DataFrame, *columns: str) -> DataFrame:
    """Newest prediction per machine, with the given columns or all."""
    if columns:
        predictions = predictions.select("prediction_id", "machine_id", "timestamp", *columns)
    return latest(predictions, "machine_id", "timestamp", "prediction_id")


def newest_n(df: DataFrame, key: str, time: str, row_id: str, n: int) -> DataFrame:
    """Newest n rows per key with their rank; each task keeps n per key before the shuffle."""
    order = Window.partitionBy(key).orderBy(F.col(time).desc(), F.col(row_id).desc())
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def recent_readings(readings: DataFrame, machine_id, n: int = 100) -> DataFrame:
    """Newest readings of one machine."""
    return _recent(readings, "reading_id", machine_id, n)


def recent_predictions(predictions: DataFrame, machine_id, n: int = 10) -> DataFrame:
    """Newest predictions of one machine."""
    return _recent(predictions, "prediction_id", machine_id, n)


def _recent(df: DataFrame, row_id: str, machine_id, n: int) -> DataFrame:
    own = df.filter(F.col("machine_id") == machine_id)
    return own.orderBy(F.col("timestamp").desc(), F.col(row_id).desc()).limit(n)


def latest_per_machine(readings: DataFrame, machines: DataFrame, n: int = 10) -> DataFrame:
    """Newest n readings of every machine that is not offline."""
    running = machines.filter(F.col("status") != "offline").select("machine_id")
    return newest_n(readings, "machine_id", "timestamp", "reading_id", n).join(running, "machine_id", "left_semi")


def trend_series(readings: DataFrame, sensors: list[str] = SENSORS, n: int = 24) -> DataFrame:
    """Chart points: the newest n readings per machine, oldest first, one row per sensor."""
    kept = newest_n(readings, "machine_id", "timestamp", "reading_id", n)
    oldest_first = Window.partitionBy("machine_id").orderBy(F.col("rank").desc())
    return (
        kept.withColumn("point", F.row_number().over(oldest_first))
        .select("machine_id", "point", texts.clock(F.col("timestamp")).alias("label"), *sensors)
        .unpivot(["machine_id", "point", "label"], sensors, "sensor", "value")
    )


def sensor_bands(readings: DataFrame, limits: dict[str, tuple[float, float]] = GAUGE_LIMITS) -> DataFrame:
    """Band and gauge fill of every sensor value, one row per reading and sensor."""
    gauges_of_row = F.array(
        *[
            F.struct(
                F.lit(sensor).alias("sensor"), F.col(sensor).alias("value"),
                F.lit(warning).alias("warning"), F.lit(critical).alias("critical"),
            )
            for sensor, (warning, critical) in limits.items()
        ]
    )
    return readings.select("reading_id", "machine_id", F.inline(gauges_of_row)).select(
        "reading_id", "machine_id", "sensor", "value",
        gauges.sensor_band(F.col("value"), F.col("warning"), F.col("critical")).alias("band"),
        gauges.gauge_percent(F.col("value"), F.col("critical")).alias("percent"),
    )


def machine_detail(
    machines: DataFrame, readings: DataFrame, predictions: DataFrame, alerts: DataFrame, n: int = 24
) -> DataFrame:
    """A machine with its newest n readings oldest first, its latest prediction and how many alerts
    are active; the alerts themselves are rows of ``active_alerts_of``, for they have no bound."""
    recent = (
        newest_n(readings, "machine_id", "timestamp", "reading_id", n)
        .groupBy("machine_id")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("timestamp", "reading_id", *[s for s in SENSORS if s in readings.columns]))
            ).alias("readings")
        )
    )
    prediction = latest_prediction(predictions)
    prediction = prediction.select("machine_id", F.struct(*prediction.columns).alias("prediction"))
    active = actionable(alerts).groupBy("machine_id").agg(F.count("*").alias("active_alerts"))
    return (
        machines.join(recent, "machine_id", "left")
        .join(prediction, "machine_id", "left")
        .join(active, "machine_id", "left")
        .withColumn("active_alerts", F.coalesce("active_alerts", F.lit(0)))
    )


def active_alerts_of(machines: DataFrame, alerts: DataFrame) -> DataFrame:
    """Active alerts of the given machines, one row each."""
    return actionable(alerts).join(machines.select("machine_id"), "machine_id", "left_semi")


def fleet_snapshot(machines: DataFrame, readings: DataFrame, predictions: DataFrame) -> DataFrame:
    """Each machine with its newest reading and newest prediction."""
    sensors = [s for s in SENSORS if s in readings.columns]
    scores = ["health_score", "risk_level", "rul_hours", "failure_type", "confidence"]
    reading = latest_reading(readings, *sensors).select("machine_id", F.col("timestamp").alias("read_at"), *sensors)
    prediction = latest_prediction(predictions, *scores).select(
        "machine_id", *[F.col(c).alias(f"predicted_{c}") for c in scores]
    )
    return machines.join(reading, "machine_id", "left").join(prediction, "machine_id", "left")


def production_impact(machines: DataFrame) -> DataFrame:
    """Expected downtime and production loss from the health score."""
    gap = 100.0 - F.col("health_score")
    return machines.select(
        "machine_id", F.col("name").alias("machine_name"),
        round_to(F.greatest(F.lit(0.0), gap / 10.0) * 4.0, 1).alias("downtime_hours"),
        round_to(F.greatest(F.lit(0.0), gap * 0.2), 1).alias("production_loss_percent"),
        "risk_level",
    )


def impact_bars(machines: DataFrame) -> DataFrame:
    """Impact with the band and width of its loss bar."""
    loss = F.col("production_loss_percent")
    return production_impact(machines).withColumns(
        {"loss_band": gauges.loss_band(loss), "bar_width": gauges.loss_bar_width(loss)}
    )


def production_kpis(machines: DataFrame) -> DataFrame:
    """Downtime of the whole fleet, and how many machines are at risk."""
    return production_impact(machines).agg(
        F.coalesce(exact_sum(F.col("downtime_hours"), 1), F.lit(0.0)).alias("expected_downtime_hours"),
        F.count_if(F.col("risk_level").isin(RISKY)).alias("at_risk_machines"),
    )


def risk_overview(machines: DataFrame, tickets: DataFrame) -> DataFrame:
    """Machines outside maintenance with their open tickets; sort with ``by_risk``."""
    serving = machines.filter(F.col("status") != "maintenance")
    return with_open_ticket_count(serving, tickets).select(
        "machine_id", F.col("name").alias("machine_name"), "location", "risk_level", "health_score",
        round_to(F.col("rul_hours"), 1).alias("rul_hours"), "open_tickets",
    )


def by_risk(risk: DataFrame) -> DataFrame:
    return risk.orderBy(health.risk_order(F.col("risk_level")), "machine_id")


def risk_matrix(risk: DataFrame) -> DataFrame:
    """Points of the risk matrix."""
    return risk.select(
        "machine_id", F.col("machine_name").alias("name"), F.col("health_score").alias("health"),
        F.col("rul_hours").alias("rul"), health.risk_weight(F.col("risk_level")).alias("risk"),
    )


def reallocation_candidates(risk: DataFrame) -> DataFrame:
    """Machines that should hand load over (``source``) or can take it (``target``)."""
    side = F.when(F.col("risk_level").isin(RISKY), "source").when(F.col("risk_level") == "low", "target")
    return risk.withColumn("side", side).filter(F.col("side").isNotNull())


def recommendations(risk: DataFrame) -> DataFrame:
    """Advice for every high or critical machine."""
    return risk.filter(F.col("risk_level").isin(RISKY)).select(
        "machine_id", F.col("machine_name").alias("machine"),
        F.concat(
            F.lit("Reallocate load from "), F.col("machine_name"),
            F.lit(" immediately to prevent critical failure within "),
            texts.number_text(F.col("rul_hours")), F.lit(" hours."),
        ).alias("action"),
    )


def uptime_rule(machines: DataFrame) -> DataFrame:
    """Fixed uptime figure by mean health."""
    mean = F.coalesce(exact_mean(F.col("health_score")), F.lit(0.0))
    return machines.agg(health.uptime(mean).alias("overall_uptime_percent"))


def operator_kpis(machines: DataFrame, alerts: DataFrame, users: DataFrame) -> DataFrame:
    """Per active operator: machines, critical machines, active alerts and mean health, where no score counts 0; zeros for an
    operator without machines."""
    active = actionable(alerts).groupBy("machine_id").agg(F.count("*").alias("_active"))
    own = (
        machines.filter(F.col("assigned_operator_id").isNotNull())
        .join(active, "machine_id", "left")
        .groupBy(F.col("assigned_operator_id").alias("operator_id"))
        .agg(
            F.count("*").alias("machines"),
            F.count_if(F.col("status") == "critical").alias("critical_machines"),
            F.coalesce(F.sum("_active"), F.lit(0)).alias("active_alerts"),
            exact_mean(F.coalesce("health_score", F.lit(0.0))).alias("average_health"),
        )
    )
    operators = active_users(users).filter(F.col("role") == "operator").select(F.col("user_id").alias("operator_id"))
    return operators.join(own, "operator_id", "left").fillna(0, ["machines", "critical_machines", "active_alerts", "average_health"])
