"""Alarm, gauge and dashboard bands."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from millwatch.functions.numbers import round_to
from millwatch.schemas import INGEST_LIMITS


def breaches(temperature: Column, vibration: Column, limits: dict[str, float] = INGEST_LIMITS) -> Column:
    return (temperature > limits["temperature"]) | (vibration > limits["vibration"])


def breach_type(temperature: Column, limits: dict[str, float] = INGEST_LIMITS) -> Column:
    """Name of a breach; temperature wins when both sensors are over."""
    return F.when(temperature > limits["temperature"], "CRITICAL_TEMP").otherwise("CRITICAL_VIBE")


def breach_message(machine_name: Column, temperature: Column, vibration: Column) -> Column:
    """Alarm text; values carry two decimals at most."""
    return F.concat(
        F.lit("Critical threshold breached on "), machine_name,
        F.lit(". Temp: "), round_to(temperature, 2).cast("string"),
        F.lit(", Vibe: "), round_to(vibration, 2).cast("string"),
    )


def sensor_band(value: Column, warning: Column, critical: Column) -> Column:
    return F.when(value >= critical, "critical").when(value >= warning, "warning").when(
        value.isNotNull(), "normal"
    )


def gauge_percent(value: Column, critical: Column, low: float = 0.0, high: Column | None = None) -> Column:
    """Fill of a gauge, whose end is a fifth above critical unless given."""
    end = critical * 1.2 if high is None else high
    return F.least(F.greatest((value - low) / (end - low) * 100.0, F.lit(0.0)), F.lit(100.0))


def health_band(score: Column) -> Column:
    return F.when(score < 50, "critical").when(score < 75, "warning").when(score.isNotNull(), "good")


def degradation(score: Column) -> Column:
    return 100.0 - score


def loss_band(loss_percent: Column) -> Column:
    return F.when(loss_percent > 10, "severe").when(loss_percent > 5, "moderate").when(
        loss_percent.isNotNull(), "minor"
    )


def loss_bar_width(loss_percent: Column) -> Column:
    return F.least(loss_percent * 5.0, F.lit(100.0))
