"""The scoring functions under SQL names, expanded by the analyzer into plain expressions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from millwatch.functions import health

_DRAW = "CAST(conv(substr(md5(concat(k, '|{salt}')), 1, 8), 16, 10) AS BIGINT) / 4294967295D"


def _case(position: int, text: str) -> str:
    """A CASE over the risks, with one band's low and high end in the text."""
    rows = " ".join(f"WHEN '{b[0]}' THEN {text.format(low=b[position][0], high=b[position][1])}" for b in health.RISK_BANDS)
    return f"CASE r {rows} END"


def _drawn(position: int, salt: str, scale: str) -> str:
    """A draw from the risk's band by the key, rounded to 1 / scale."""
    width = _case(position, "{high}D - {low}D")
    return f"floor(({_case(position, '{low}D')} + ({width}) * ({_DRAW.format(salt=salt)})) * {scale} + 0.5D) / {scale}"


_LEVELS = " ".join(f"WHEN h < {below} THEN '{risk}'" for risk, below, _, _ in health.RISK_BANDS[:-1])

FUNCTIONS = [
    f"""health_score(t DOUBLE, v DOUBLE) RETURNS DOUBLE RETURN
       greatest(0D, least(100D, 100D - greatest(0D, t - {health.NORMAL_TEMPERATURE}D) * {health.TEMPERATURE_COST}D
         - greatest(0D, v - {health.NORMAL_VIBRATION}D) * {health.VIBRATION_COST}D))""",
    f"""risk_level(h DOUBLE) RETURNS STRING RETURN
       CASE {_LEVELS} WHEN h IS NOT NULL THEN '{health.RISK_BANDS[-1][0]}' END""",
    f"rul_hours(r STRING, k STRING) RETURNS DOUBLE RETURN {_drawn(2, 'rul', '10D')}",
    f"prediction_confidence(r STRING, k STRING) RETURNS DOUBLE RETURN {_drawn(3, 'confidence', '100D')}",
    f"""failure_type(r STRING, v DOUBLE) RETURNS STRING RETURN
       CASE r WHEN 'critical' THEN CASE WHEN v > {health.BEARING_VIBRATION} THEN 'Bearing Failure' ELSE 'Overheating' END
              WHEN 'high' THEN 'Impending Component Wear' WHEN 'medium' THEN 'Minor Degradation'
              WHEN 'low' THEN 'None' END""",
    """machine_status(r STRING) RETURNS STRING RETURN
       CASE r WHEN 'critical' THEN 'critical' WHEN 'high' THEN 'warning' WHEN 'medium' THEN 'warning'
              WHEN 'low' THEN 'normal' END""",
    """alert_severity(r STRING) RETURNS STRING RETURN
       CASE WHEN r IN ('critical', 'high', 'medium', 'low') THEN r END""",
    """breach_type(t DOUBLE, t_limit DOUBLE) RETURNS STRING RETURN
       CASE WHEN t > t_limit THEN 'CRITICAL_TEMP' ELSE 'CRITICAL_VIBE' END""",
    """sensor_band(x DOUBLE, warning DOUBLE, critical DOUBLE) RETURNS STRING RETURN
       CASE WHEN x >= critical THEN 'critical' WHEN x >= warning THEN 'warning'
            WHEN x IS NOT NULL THEN 'normal' END""",
    """gauge_percent(x DOUBLE, critical DOUBLE) RETURNS DOUBLE RETURN
       least(greatest(x / (critical * 1.2D) * 100D, 0D), 100D)""",
    """health_band(h DOUBLE) RETURNS STRING RETURN
       CASE WHEN h < 50 THEN 'critical' WHEN h < 75 THEN 'warning' WHEN h IS NOT NULL THEN 'good' END""",
    """loss_band(p DOUBLE) RETURNS STRING RETURN
       CASE WHEN p > 10 THEN 'severe' WHEN p > 5 THEN 'moderate' WHEN p IS NOT NULL THEN 'minor' END""",
    """risk_order(r STRING) RETURNS INT RETURN
       CASE r WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END""",
    """month_period(y INT, m INT) RETURNS STRING RETURN concat(CAST(y AS STRING), '-', lpad(CAST(m AS STRING), 2, '0'))""",
    """label_text(w STRING) RETURNS STRING RETURN upper(regexp_replace(w, '^([^_]*)_', '$1 '))""",
]


def register_functions(spark: SparkSession) -> list[str]:
    """Create the temporary SQL functions of this session; gives their names."""
    for body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {body}")
    return [body.split("(", 1)[0] for body in FUNCTIONS]
