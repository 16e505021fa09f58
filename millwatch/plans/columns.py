"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from millwatch.functions import gauges, health, texts
from millwatch.functions.sql import register_functions
from millwatch.operators import admin, assets, scoring
from millwatch.plans.registry import query
from millwatch.session import new_folder


@query("f1_health_score", "SELECT reading_id, raw_score AS health_score FROM fx_scored")
def f1(d):
    return d.readings().select("reading_id", health.health_score(F.col("temperature"), F.col("vibration")).alias("health_score"))


@query("f2_risk_level", "SELECT reading_id, risk_level FROM fx_scored")
def f2(d):
    score = health.health_score(F.col("temperature"), F.col("vibration"))
    return d.readings().select("reading_id", health.risk_level(score).alias("risk_level"))


@query("f3_rul_hours", "SELECT prediction_id, risk_level, rul_hours FROM fx_predictions")
def f3(d):
    return d.predictions().select("prediction_id", "risk_level", "rul_hours")


@query("f4_confidence", "SELECT prediction_id, risk_level, confidence FROM fx_predictions")
def f4(d):
    return d.predictions().select("prediction_id", "risk_level", "confidence")


@query("f5_failure_type", "SELECT prediction_id, failure_type FROM fx_predictions")
def f5(d):
    return d.predictions().select("prediction_id", "failure_type")


@query(
    "f6_default_prediction",
    """SELECT m.machine_id, coalesce(p.health_score, 100E0) AS health_score, coalesce(p.risk_level, 'low') AS risk_level,
         coalesce(p.rul_hours, 2000E0) AS rul_hours, coalesce(p.failure_type, 'None') AS failure_type,
         coalesce(p.confidence, 0.95E0) AS confidence
       FROM fx_machines m LEFT JOIN fx_latest_prediction p ON m.machine_id = p.machine_id""",
)
def f6(d):
    return scoring.with_default_prediction(d.machines(), assets.latest_prediction(d.predictions(), *health.NO_READINGS))


@query(
    "f7_machine_status",
    """SELECT reading_id, CASE risk_level WHEN 'critical' THEN 'critical' WHEN 'low' THEN 'normal' ELSE 'warning' END AS status,
         risk_level AS severity FROM fx_scored""",
)
def f7(d):
    risk = F.col("risk_level")
    return d.predictions().select(
        F.col("prediction_id").alias("reading_id"), health.machine_status(risk).alias("status"), health.severity(risk).alias("severity")
    )


@query(
    "f8_breach_type",
    """SELECT reading_id, CASE WHEN temperature > 85 THEN 'CRITICAL_TEMP' ELSE 'CRITICAL_VIBE' END AS breach,
         'Critical threshold breached on ' || name || '. Temp: ' || CAST(floor(temperature * 100 + 0.5) / 100 AS VARCHAR)
           || ', Vibe: ' || CAST(floor(vibration * 100 + 0.5) / 100 AS VARCHAR) AS message
       FROM fx_readings r JOIN fx_machines m ON r.machine_id = m.machine_id
       WHERE temperature > 85 OR vibration > 0.65E0""",
)
def f8(d):
    t, v = F.col("temperature"), F.col("vibration")
    return (
        d.readings().filter(gauges.breaches(t, v)).join(d.machines().select("machine_id", "name"), "machine_id")
        .select("reading_id", gauges.breach_type(t).alias("breach"), gauges.breach_message(F.col("name"), t, v).alias("message"))
    )


BANDS = """FROM (
  SELECT reading_id, 'temperature' AS sensor, temperature AS value, 70E0 AS w, 90E0 AS c FROM fx_readings
  UNION ALL SELECT reading_id, 'vibration', vibration, 5E0, 10E0 FROM fx_readings
  UNION ALL SELECT reading_id, 'pressure', pressure, 8E0, 12E0 FROM fx_readings
  UNION ALL SELECT reading_id, 'current', current_a, 15E0, 20E0 FROM fx_readings
  UNION ALL SELECT reading_id, 'rpm', rpm, 3000E0, 3600E0 FROM fx_readings
  UNION ALL SELECT reading_id, 'noise_level', noise_level, 80E0, 95E0 FROM fx_readings) s"""


@query(
    "f9_sensor_band",
    f"SELECT reading_id, sensor, CASE WHEN value >= c THEN 'critical' WHEN value >= w THEN 'warning' ELSE 'normal' END AS band {BANDS}",
)
def f9(d):
    return assets.sensor_bands(d.readings()).select("reading_id", "sensor", "band")


@query(
    "f10_gauge_percent",
    f"SELECT reading_id, sensor, value, least(greatest((value - 0E0) / (c * 1.2E0 - 0E0) * 100E0, 0E0), 100E0) AS percent {BANDS}",
)
def f10(d):
    return assets.sensor_bands(d.readings()).select("reading_id", "sensor", "value", "percent")


@query(
    "f11_health_band",
    """SELECT machine_id, CASE WHEN health_score < 50 THEN 'critical' WHEN health_score < 75 THEN 'warning' ELSE 'good' END AS band,
         100E0 - health_score AS degradation FROM fx_machines""",
)
def f11(d):
    h = F.col("health_score")
    return d.machines().select("machine_id", gauges.health_band(h).alias("band"), gauges.degradation(h).alias("degradation"))


@query(
    "f12_loss_band",
    """SELECT machine_id, production_loss_percent,
         CASE WHEN production_loss_percent > 10 THEN 'severe' WHEN production_loss_percent > 5 THEN 'moderate' ELSE 'minor' END AS loss_band,
         least(production_loss_percent * 5E0, 100E0) AS bar_width FROM fx_impact""",
)
def f12(d):
    return assets.impact_bars(d.machines()).select("machine_id", "production_loss_percent", "loss_band", "bar_width")


@query(
    "f13_periods",
    """SELECT ticket_id, CAST(line_no AS BIGINT) AS line_no, CAST(year AS VARCHAR) || '-' || lpad(CAST(month AS VARCHAR), 2, '0') AS period,
         CAST(year AS VARCHAR) AS year_text FROM fx_cost_logs""",
)
def f13(d):
    period = texts.month_period(F.col("year"), F.col("month"))
    return d.cost_logs().select("ticket_id", "line_no", period.alias("period"), texts.year_of(period).alias("year_text"))


@query(
    "f14_labels",
    """SELECT ticket_id, upper(CASE WHEN instr(status, '_') > 0
         THEN substr(status, 1, instr(status, '_') - 1) || ' ' || substr(status, instr(status, '_') + 1) ELSE status END) AS label
       FROM fx_tickets""",
)
def f14(d):
    return d.tickets().select("ticket_id", texts.label(F.col("status")).alias("label"))


@query(
    "f15_time_texts",
    """SELECT log_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso, strftime(ts, '%H:%M') AS clock,
         strftime(ts, '%b %-d, %H:%M:%S') AS long_clock FROM fx_audit_logs""",
)
def f15(d):
    ts = F.col("timestamp")
    return d.audit_logs().select(
        "log_id", texts.iso_time(ts).alias("iso"), texts.clock(ts).alias("clock"), texts.long_clock(ts).alias("long_clock")
    )


@query(
    "f16_json_values",
    """SELECT log_id, json_extract_string(new_value, '$.k') AS new_k, len(json_keys(new_value)) AS fields
       FROM fx_audit_logs""",
)
def f16(d):
    return d.audit_logs().select(
        "log_id", texts.json_value(F.col("new_value"), "k").alias("new_k"),
        F.size(F.map_keys(texts.json_map(F.col("new_value")))).alias("fields"),
    )


def stored_values(d):
    """Audit rows as stored with VARIANT values."""
    path = new_folder(d.spark, "audit")
    admin.audit_values(d.audit_logs()).write.parquet(path)
    return d.spark.read.parquet(path)


@query("f16_json_variant", like="f16_json_values")
def f16_variant(d):
    value = F.col("new_value")
    return stored_values(d).select("log_id", texts.variant_text(value, "k").alias("new_k"), F.size(texts.variant_fields(value)).alias("fields"))


@query(
    "j4_audit_values",
    """SELECT log_id, coalesce(name, 'System') AS user_name, json_extract_string(new_value, '$.k') AS new_k, CAST(NULL AS VARCHAR) AS old_k
       FROM fx_audit_logs a LEFT JOIN fx_users u ON a.user_id = u.user_id""",
)
def j4_values(d):
    """The trail over the stored values; the old value is null here."""
    trail = admin.audit_trail(stored_values(d), d.users())
    return trail.select("log_id", "user_name", texts.variant_text(F.col("new_value"), "k").alias("new_k"), texts.variant_text(F.col("old_value"), "k").alias("old_k"))


@query(
    "x1_sql_functions",
    """SELECT p.prediction_id, raw_score AS health_score, p.risk_level, rul_hours, confidence, failure_type,
         CASE p.risk_level WHEN 'critical' THEN 'critical' WHEN 'low' THEN 'normal' ELSE 'warning' END AS status
       FROM fx_predictions p JOIN fx_scored s ON p.prediction_id = s.reading_id""",
)
def x1(d):
    register_functions(d.spark)
    scored = d.readings().selectExpr("reading_id", "vibration", "health_score(temperature, vibration) AS health_score")
    return scored.selectExpr("*", "risk_level(health_score) AS risk_level", "CAST(reading_id AS STRING) AS k").selectExpr(
        "reading_id AS prediction_id", "health_score", "risk_level", "rul_hours(risk_level, k) AS rul_hours",
        "prediction_confidence(risk_level, k) AS confidence", "failure_type(risk_level, vibration) AS failure_type",
        "machine_status(risk_level) AS status",
    )


@query("x2_model_scores", "SELECT reading_id, raw_score AS health_score FROM fx_scored")
def x2(d):
    return scoring.score_with_model(
        d.readings().select("reading_id", "temperature", "vibration"), _linear_model, "reading_id bigint, health_score double"
    )


def _linear_model():
    """Stand-in for a loaded model: the same score on whole batches."""

    def predict(batch):
        heat = (batch["temperature"] - health.NORMAL_TEMPERATURE).clip(lower=0.0) * health.TEMPERATURE_COST
        shake = (batch["vibration"] - health.NORMAL_VIBRATION).clip(lower=0.0) * health.VIBRATION_COST
        return batch.assign(health_score=(100.0 - heat - shake).clip(0.0, 100.0))[["reading_id", "health_score"]]

    return predict
