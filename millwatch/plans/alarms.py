"""Queries of alarms, fleet scoring, escalation and de-duplication over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millwatch.operators import alerts, events, scoring
from millwatch.plans.registry import query

AS_OF = "2024-01-31 00:00:00"
# Limits near the dashboard's critical ones, which far fewer readings pass than the ingest limits.
HIGH_LIMITS = {"temperature": 90.0, "vibration": 5.0}


def _alarm_view(temperature: str, vibration: str) -> str:
    return f"""(SELECT md5(CAST(reading_id AS VARCHAR) || '|alarm') AS alert_id, r.machine_id, ts AS triggered_at, 'critical' AS severity,
      'pending' AS status, false AS auto_escalated, CASE WHEN temperature > {temperature} THEN 'CRITICAL_TEMP' ELSE 'CRITICAL_VIBE' END AS type,
      'Critical threshold breached on ' || name || '. Temp: ' || CAST(floor(temperature * 100 + 0.5) / 100 AS VARCHAR)
        || ', Vibe: ' || CAST(floor(vibration * 100 + 0.5) / 100 AS VARCHAR) AS message
      FROM fx_readings r JOIN fx_machines m ON r.machine_id = m.machine_id WHERE temperature > {temperature} OR vibration > {vibration})"""


ALARMS, HIGH_ALARMS = _alarm_view("85", "0.65E0"), _alarm_view("90", "5")


@query("t1_threshold_alerts", f"SELECT * FROM {ALARMS} a")
def t1(d):
    return alerts.threshold_alerts(d.readings(), d.machines())


@query("t1_high_limits", f"SELECT * FROM {HIGH_ALARMS} a")
def t1_high(d):
    return alerts.threshold_alerts(d.readings(), d.machines(), HIGH_LIMITS)


@query(
    "t1_machine_changes",
    f"""SELECT machine_id, 'critical' AS risk_level, 'warning' AS status, max(triggered_at) AS last_updated FROM {ALARMS} a GROUP BY machine_id""",
)
def t1_machines(d):
    return alerts.alarmed_machines(alerts.threshold_alerts(d.readings(), d.machines()))


@query(
    "t1_machines",
    f"""SELECT machine_id, CASE WHEN machine_id IN (SELECT machine_id FROM {HIGH_ALARMS} a) THEN 'critical' ELSE risk_level END AS risk_level,
          CASE WHEN machine_id IN (SELECT machine_id FROM {HIGH_ALARMS} a) THEN 'warning' ELSE status END AS status FROM fx_machines""",
)
def t1_after(d):
    alarms = alerts.threshold_alerts(d.readings(), d.machines(), HIGH_LIMITS)
    return alerts.apply_alarms(d.machines(), alarms).select("machine_id", "risk_level", "status")


def _iso(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%dT%H:%M:%S.%f')"


@query(
    "t1_events",
    f"""SELECT '{{"type":"alert_new","timestamp":"' || {_iso('triggered_at')} || '","payload":{{"alert_id":"' || alert_id || '","machine_id":'
          || CAST(machine_id AS VARCHAR) || ',"type":"' || type || '","severity":"critical","status":"pending","message":"' || message
          || '","triggered_at":"' || {_iso('triggered_at')} || '"}}}}' AS value FROM {ALARMS} a""",
)
def t1_events(d):
    alarms = alerts.threshold_alerts(d.readings(), d.machines())
    return events.to_event_json(alerts.alarm_payload(alarms), "alert_new", "triggered_at")


FLEET = """(SELECT p.* FROM fx_latest_prediction p JOIN fx_machines m ON p.machine_id = m.machine_id WHERE m.status <> 'offline')"""


@query(
    "t2_score_fleet",
    f"""SELECT prediction_id, machine_id, ts AS "timestamp", health_score, risk_level, rul_hours, failure_type, confidence,
          'v1.0.0-sim' AS model_version FROM {FLEET} f""",
)
def t2(d):
    return scoring.score_fleet(d.readings(), d.machines())


@query(
    "t2_machine_updates",
    f"""SELECT machine_id, health_score, risk_level, rul_hours, CASE risk_level WHEN 'critical' THEN 'critical' WHEN 'low' THEN 'normal'
          ELSE 'warning' END AS status, TIMESTAMP '{AS_OF}' AS last_updated FROM {FLEET} f""",
)
def t2_updates(d):
    return scoring.machine_updates(scoring.score_fleet(d.readings(), d.machines()), AS_OF)


@query(
    "t2_machines",
    f"""SELECT m.machine_id, coalesce(f.health_score, m.health_score) AS health_score, coalesce(f.risk_level, m.risk_level) AS risk_level,
          coalesce(f.rul_hours, m.rul_hours) AS rul_hours, CASE f.risk_level WHEN 'critical' THEN 'critical' WHEN 'low' THEN 'normal'
            WHEN 'high' THEN 'warning' WHEN 'medium' THEN 'warning' ELSE m.status END AS status
        FROM fx_machines m LEFT JOIN {FLEET} f ON f.machine_id = m.machine_id""",
)
def t2_machines(d):
    after = scoring.scoring_run(d.readings(), d.machines(), d.alerts(), AS_OF)["machines"]
    return after.select("machine_id", "health_score", "risk_level", "rul_hours", "status")


CANDIDATE = """SELECT md5(CAST(prediction_id AS VARCHAR) || '|alert') AS alert_id, machine_id, ts AS triggered_at, risk_level AS severity,
  'pending' AS status, false AS auto_escalated"""


@query(
    "t2_new_alerts",
    f"""{CANDIDATE} FROM {FLEET} f WHERE risk_level IN ('high', 'critical') AND machine_id NOT IN (SELECT machine_id FROM fx_active)""",
)
def t2_alerts(d):
    """The alerts that a scoring run opens. In the test tables every machine at risk has an open alert already, so there may
    be none; the rule itself is tested with rows of its own."""
    return scoring.scoring_run(d.readings(), d.machines(), d.alerts(), AS_OF)["alerts"]


@query(
    "t2_new_alerts_after_answers",
    f"""{CANDIDATE} FROM {FLEET} f WHERE risk_level IN ('high', 'critical')""",
)
def t2_alerts_answered(d):
    """The same run after every open alert was answered: each machine at risk gets one."""
    answered = d.alerts().withColumn("status", F.lit("acknowledged"))
    return scoring.scoring_run(d.readings(), d.machines(), answered, AS_OF)["alerts"]


TICK = """(SELECT *, CASE WHEN date_trunc('minute', triggered_at) = triggered_at THEN triggered_at + INTERVAL 5 MINUTE
  ELSE date_trunc('minute', triggered_at) + INTERVAL 6 MINUTE END AS tick FROM fx_alerts)"""
NOON = "2024-01-20 12:00:00"


@query(
    "t3_escalate",
    f"""SELECT alert_id, triggered_at, CASE WHEN status = 'pending' AND tick <= TIMESTAMP '{NOON}' THEN 'escalated' ELSE status END AS status,
          status = 'pending' AND tick <= TIMESTAMP '{NOON}' AS auto_escalated,
          CASE WHEN status = 'pending' AND tick <= TIMESTAMP '{NOON}' THEN tick END AS escalated_at FROM {TICK} t""",
)
def t3(d):
    after = alerts.escalate(d.alerts(), NOON)
    return after.select("alert_id", "triggered_at", "status", "auto_escalated", "escalated_at")


@query(
    "t4_dedupe_alerts",
    """WITH line AS (SELECT user_id AS machine_id, ts AS t, 0 AS side, CAST(NULL AS BIGINT) AS prediction_id, NULL AS severity
           FROM events WHERE event_type = 'signup'
         UNION ALL SELECT machine_id, ts, 1, prediction_id, risk_level FROM fx_predictions WHERE risk_level IN ('high', 'critical')),
       numbered AS (SELECT *, sum(1 - side) OVER (PARTITION BY machine_id ORDER BY t, side, md5(CAST(prediction_id AS VARCHAR) || '|alert')
           ROWS UNBOUNDED PRECEDING) AS epoch FROM line)
       SELECT md5(CAST(prediction_id AS VARCHAR) || '|alert') AS alert_id, machine_id, t AS triggered_at, severity FROM numbered WHERE side = 1
       QUALIFY row_number() OVER (PARTITION BY machine_id, epoch ORDER BY t, md5(CAST(prediction_id AS VARCHAR) || '|alert')) = 1""",
)
def t4(d):
    opened = alerts.dedupe_alerts(scoring.alert_candidates(d.predictions()), responses(d))
    return opened.select("alert_id", "machine_id", "triggered_at", "severity")


def responses(d):
    """Every sign-up counts as the answer to whatever alert its machine has open."""
    return d.stored("events").filter("event_type = 'signup'").selectExpr("user_id AS machine_id", "ts AS responded_at")
