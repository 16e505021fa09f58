"""Machine health, risk, remaining useful life and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from millwatch.functions.numbers import round_to, uniform

# The level above which a sensor costs health, and the cost per unit.
NORMAL_TEMPERATURE, TEMPERATURE_COST = 45.0, 1.5
NORMAL_VIBRATION, VIBRATION_COST = 2.0, 10.0

# A score below the bound has the risk; (RUL hours) and (confidence) are its bands.
RISK_BANDS = [
    # risk, below, rul band, confidence band
    ("critical", 30.0, (5.0, 48.0), (0.85, 0.98)),
    ("high", 60.0, (48.0, 168.0), (0.75, 0.85)),
    ("medium", 80.0, (168.0, 720.0), (0.65, 0.75)),
    ("low", None, (720.0, 2000.0), (0.9, 0.99)),
]
# Texts of a predicted failure; a vibration above 5 points at the bearing.
BEARING_VIBRATION = 5.0
MODEL_VERSION = "v1.0.0-sim"
# The prediction for a machine without readings.
NO_READINGS = {
    "health_score": 100.0,
    "risk_level": "low",
    "rul_hours": 2000.0,
    "failure_type": "None",
    "confidence": 0.95,
}


# The uptime figure shown where the fleet's mean health is above the bound, and elsewhere.
UPTIME_BOUND, UPTIME_GOOD, UPTIME_POOR = 50, 94.7, 78.2


def uptime(mean_health: Column) -> Column:
    return F.when(mean_health > UPTIME_BOUND, UPTIME_GOOD).otherwise(UPTIME_POOR)


def health_score(temperature: Column, vibration: Column) -> Column:
    heat = F.greatest(F.lit(0.0), temperature - NORMAL_TEMPERATURE) * TEMPERATURE_COST
    shake = F.greatest(F.lit(0.0), vibration - NORMAL_VIBRATION) * VIBRATION_COST
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - heat - shake))


def risk_level(score: Column) -> Column:
    level = F
    for risk, below, _, _ in RISK_BANDS[:-1]:
        level = level.when(score < below, risk)
    return level.when(score.isNotNull(), RISK_BANDS[-1][0])


def _by_risk(risk: Column, position: int, bound: int) -> Column:
    value = F
    for band in RISK_BANDS:
        value = value.when(risk == band[0], F.lit(band[position][bound]))
    return value


def rul_hours(risk: Column, key: Column) -> Column:
    """Hours left, drawn from the band of the risk by the prediction key."""
    low, high = _by_risk(risk, 2, 0), _by_risk(risk, 2, 1)
    return round_to(low + (high - low) * uniform(key, "rul"), 1)


def confidence(risk: Column, key: Column) -> Column:
    low, high = _by_risk(risk, 3, 0), _by_risk(risk, 3, 1)
    return round_to(low + (high - low) * uniform(key, "confidence"), 2)


def failure_type(risk: Column, vibration: Column) -> Column:
    return (
        F.when((risk == "critical") & (vibration > BEARING_VIBRATION), "Bearing Failure")
        .when(risk == "critical", "Overheating")
        .when(risk == "high", "Impending Component Wear")
        .when(risk == "medium", "Minor Degradation")
        .when(risk == "low", "None")
    )


def machine_status(risk: Column) -> Column:
    return (
        F.when(risk == "critical", "critical")
        .when(risk.isin("high", "medium"), "warning")
        .when(risk == "low", "normal")
    )


def severity(risk: Column) -> Column:
    return F.when(risk.isin("critical", "high", "medium", "low"), risk)


def risk_order(risk: Column) -> Column:
    """Sort position, worst first; an unknown word sorts last."""
    return (
        F.when(risk == "critical", 0).when(risk == "high", 1).when(risk == "medium", 2)
        .when(risk == "low", 3).otherwise(4)
    )


def risk_weight(risk: Column) -> Column:
    """Height in the risk matrix, 4 for critical down to 1."""
    return F.when(risk == "critical", 4).when(risk == "high", 3).when(risk == "medium", 2).otherwise(1)
