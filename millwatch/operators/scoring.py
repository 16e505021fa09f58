"""Scoring of readings and of the fleet."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from millwatch.functions import health
from millwatch.functions.numbers import round_to
from millwatch.operators.assets import latest_reading
from millwatch.operators.alerts import actionable
from millwatch.operators.changes import SET, apply_changes
from millwatch.operators.times import moment


def score_readings(readings: DataFrame) -> DataFrame:
    """One prediction per reading. Bands test the unrounded score; the stored score has one decimal."""
    score = F.col("_score")
    return (
        readings.withColumn("_score", health.health_score(F.col("temperature"), F.col("vibration")))
        .withColumn("risk_level", health.risk_level(score))
        .select(
            F.col("reading_id").alias("prediction_id"),
            "machine_id",
            "timestamp",
            round_to(score, 1).alias("health_score"),
            "risk_level",
            health.rul_hours(F.col("risk_level"), F.col("reading_id")).alias("rul_hours"),
            health.failure_type(F.col("risk_level"), F.col("vibration")).alias("failure_type"),
            health.confidence(F.col("risk_level"), F.col("reading_id")).alias("confidence"),
            F.lit(health.MODEL_VERSION).alias("model_version"),
        )
    )


def score_fleet(readings: DataFrame, machines: DataFrame) -> DataFrame:
    """Newest reading of every machine that is not offline, scored; machines without one are left out."""
    newest = latest_reading(readings, "temperature", "vibration")
    running = machines.filter(F.col("status") != "offline").select("machine_id")
    return score_readings(newest.join(running, "machine_id", "left_semi"))


def machine_updates(predictions: DataFrame, as_of: str) -> DataFrame:
    """The columns of a machine that a scoring run sets."""
    return predictions.select(
        "machine_id", "health_score", "risk_level", "rul_hours",
        health.machine_status(F.col("risk_level")).alias("status"),
        moment(as_of, predictions, "timestamp").alias("last_updated"),
    )


def apply_scores(machines: DataFrame, updates: DataFrame) -> DataFrame:
    """Machines after a scoring run; those without an update stay as they are."""
    columns = [c for c in updates.columns if c != "machine_id"]
    change = updates.withColumns({"seq": F.lit(0), SET: F.array(*[F.lit(c) for c in columns])})
    return apply_changes(machines, change, "machine_id")


def scoring_run(readings: DataFrame, machines: DataFrame, alerts: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """The every-minute job: predictions, machines after them, and the alerts it opens."""
    predictions = score_fleet(readings, machines)
    return {
        "predictions": predictions,
        "machines": apply_scores(machines, machine_updates(predictions, as_of)),
        "alerts": machines_needing_alert(alert_candidates(predictions), alerts),
    }


def alert_candidates(predictions: DataFrame) -> DataFrame:
    """A pending alert for each high or critical prediction."""
    return predictions.filter(F.col("risk_level").isin("high", "critical")).select(
        F.md5(F.concat(F.col("prediction_id").cast("string"), F.lit("|alert"))).alias("alert_id"),
        "machine_id",
        F.col("timestamp").alias("triggered_at"),
        health.severity(F.col("risk_level")).alias("severity"),
        F.lit("pending").alias("status"),
        F.lit(False).alias("auto_escalated"),
    )


def machines_needing_alert(candidates: DataFrame, alerts: DataFrame) -> DataFrame:
    """Candidates whose machine has no pending or escalated alert."""
    busy = actionable(alerts).select("machine_id").distinct()
    return candidates.join(busy, "machine_id", "left_anti")


def with_default_prediction(machines: DataFrame, predictions: DataFrame) -> DataFrame:
    """Prediction of each machine, the healthy default where it has none."""
    joined = machines.select("machine_id").join(
        predictions.select("machine_id", *health.NO_READINGS), "machine_id", "left"
    )
    return joined.select(
        "machine_id",
        *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in health.NO_READINGS.items()],
    )


def score_with_model(
    readings: DataFrame, load_model: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str
) -> DataFrame:
    """Score with any model of pandas batches; the model is loaded once per partition."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_model()
        for batch in batches:
            yield model(batch)

    return readings.mapInPandas(score, schema)
