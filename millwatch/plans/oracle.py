"""The fleet mapping of the test tables in ANSI SQL, as views that oracle queries build on."""

from __future__ import annotations

import re

VIEWS = {
    "fx_users": """
SELECT s_suppkey AS user_id, s_name AS name, lower(replace(s_name, '#', '.')) || '@example.com' AS email,
  CASE s_suppkey % 6 WHEN 0 THEN 'operator' WHEN 1 THEN 'mechanic' WHEN 2 THEN 'maintenance_manager'
    WHEN 3 THEN 'production_manager' WHEN 4 THEN 'factory_owner' ELSE 'admin' END AS role,
  s_suppkey % 10 <> 3 AS is_active
FROM supplier""",
    "fx_mechanics": """
SELECT s_suppkey AS mechanic_id,
  CASE s_nationkey % 2 WHEN 0 THEN 'Electrical & Mechanical' ELSE 'Hydraulics & Pneumatics' END AS skill_type,
  CASE s_nationkey % 3 WHEN 0 THEN 'available' WHEN 1 THEN 'busy' ELSE 'offline' END AS login_status,
  CASE WHEN s_nationkey % 3 = 1 THEN s_suppkey END AS current_assignment_id,
  CASE s_nationkey % 2 WHEN 0 THEN 'Morning' ELSE 'Evening' END AS shift
FROM supplier WHERE s_suppkey % 6 = 1""",
    "fx_machines": """
SELECT machine_id, name, location, type, assigned_operator_id, health_score,
  CASE WHEN health_score < 30 THEN 'critical' WHEN health_score < 60 THEN 'high'
       WHEN health_score < 80 THEN 'medium' ELSE 'low' END AS risk_level,
  floor(health_score * 20 * 10 + 0.5) / 10 AS rul_hours,
  CASE WHEN machine_id % 13 = 0 THEN 'offline' WHEN machine_id % 17 = 5 THEN 'maintenance'
       WHEN health_score < 30 THEN 'critical' WHEN health_score < 80 THEN 'warning' ELSE 'normal' END AS status
FROM (SELECT c_custkey AS machine_id, c_name AS name, n_name AS location, c_mktsegment AS type,
        CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST((c_nationkey % 4) * 6 AS BIGINT) END AS assigned_operator_id,
        floor(greatest(0, least(100, (c_acctbal + 1000) / 110)) * 10 + 0.5) / 10 AS health_score
      FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey) m""",
    "fx_readings": """
SELECT event_id AS reading_id, user_id AS machine_id, ts, 40 + value * 0.2E0 AS temperature,
  0.2E0 + CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) * 0.05E0 AS vibration,
  2 + (event_id % 113) / 10.0E0 AS pressure, 10 + (event_id % 131) / 10.0E0 AS current_a,
  CAST(1500 + (event_id * 7) % 2200 AS DOUBLE) AS rpm, CAST(55 + (event_id % 45) AS DOUBLE) AS noise_level
FROM events""",
    "fx_scored": """
SELECT *, CASE WHEN raw_score < 30 THEN 'critical' WHEN raw_score < 60 THEN 'high'
    WHEN raw_score < 80 THEN 'medium' ELSE 'low' END AS risk_level,
  CAST('0x' || substr(md5(CAST(reading_id AS VARCHAR) || '|rul'), 1, 8) AS BIGINT) / 4294967295.0E0 AS u_rul,
  CAST('0x' || substr(md5(CAST(reading_id AS VARCHAR) || '|confidence'), 1, 8) AS BIGINT) / 4294967295.0E0 AS u_conf
FROM (SELECT *, greatest(0E0, least(100E0, 100E0 - greatest(0E0, temperature - 45E0) * 1.5E0
        - greatest(0E0, vibration - 2E0) * 10E0)) AS raw_score FROM fx_readings) r""",
    "fx_predictions": """
SELECT reading_id AS prediction_id, machine_id, ts, floor(raw_score * 10 + 0.5) / 10 AS health_score, risk_level,
  floor(10 * CASE risk_level WHEN 'critical' THEN 5E0 + (48E0 - 5E0) * u_rul WHEN 'high' THEN 48E0 + (168E0 - 48E0) * u_rul
    WHEN 'medium' THEN 168E0 + (720E0 - 168E0) * u_rul ELSE 720E0 + (2000E0 - 720E0) * u_rul END + 0.5) / 10 AS rul_hours,
  CASE risk_level WHEN 'critical' THEN CASE WHEN vibration > 5 THEN 'Bearing Failure' ELSE 'Overheating' END
    WHEN 'high' THEN 'Impending Component Wear' WHEN 'medium' THEN 'Minor Degradation' ELSE 'None' END AS failure_type,
  floor(100 * CASE risk_level WHEN 'critical' THEN 0.85E0 + (0.98E0 - 0.85E0) * u_conf
    WHEN 'high' THEN 0.75E0 + (0.85E0 - 0.75E0) * u_conf WHEN 'medium' THEN 0.65E0 + (0.75E0 - 0.65E0) * u_conf
    ELSE 0.9E0 + (0.99E0 - 0.9E0) * u_conf END + 0.5) / 100 AS confidence
FROM fx_scored""",
    "fx_alerts": """
SELECT reading_id AS alert_id, machine_id, ts AS triggered_at,
  CASE WHEN temperature > 100 THEN 'critical' WHEN temperature > 85 THEN 'high'
       WHEN temperature > 70 THEN 'medium' ELSE 'low' END AS severity,
  CASE reading_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'acknowledged' WHEN 2 THEN 'escalated' ELSE 'resolved' END AS status,
  CASE WHEN reading_id % 4 = 1 THEN CASE WHEN reading_id % 8 = 1 THEN 'reported' ELSE 'ignored' END END AS operator_response
FROM fx_readings WHERE temperature > 60""",
    "fx_tickets": """
SELECT o_orderkey AS ticket_id, o_custkey AS machine_id, (o_orderkey % 25) * 6 AS operator_id, st AS status,
  CASE WHEN st = 'open' THEN NULL ELSE (o_orderkey % 20) * 6 + 1 END AS mechanic_id,
  o_orderpriority AS description, o_orderpriority = '1-URGENT' AS escalated, o_orderdate AS created_at,
  CASE WHEN st IN ('reviewed', 'closed') THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS repair_cost,
  CASE WHEN st IN ('repaired', 'reviewed', 'closed') THEN CAST((o_orderkey % 80) / 10.0E0 AS DECIMAL(6,1)) END AS time_taken_hours,
  CASE WHEN st = 'closed' THEN o_orderdate + to_hours(o_orderkey % 72) END AS closed_at
FROM (SELECT *, CASE o_orderkey % 8 WHEN 0 THEN 'open' WHEN 1 THEN 'assigned' WHEN 2 THEN 'accepted'
        WHEN 3 THEN 'in_progress' WHEN 4 THEN 'paused' WHEN 5 THEN 'repaired' WHEN 6 THEN 'reviewed'
        ELSE 'closed' END AS st FROM orders) o""",
    "fx_cost_logs": """
SELECT l_orderkey AS ticket_id, l_linenumber AS line_no, o_custkey AS machine_id,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
  CAST(month(l_shipdate) AS INT) AS month, CAST(year(l_shipdate) AS INT) AS year, l_suppkey AS approved_by
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "fx_audit_logs": """
SELECT event_id AS log_id, user_id, upper(event_type) AS action,
  CASE event_id % 3 WHEN 0 THEN 'ticket' WHEN 1 THEN 'alert' ELSE 'machine' END AS entity_type,
  event_id % 1000 AS entity_id, props AS new_value, ts
FROM events""",
    "fx_schedules": """
SELECT p_partkey AS schedule_id, (p_partkey * 7) % 1700 AS machine_id, p_name AS product,
  CASE p_size % 4 WHEN 0 THEN 'on_track' WHEN 1 THEN 'delayed' WHEN 2 THEN 'halted' ELSE 'cancelled' END AS status,
  CASE p_size % 4 WHEN 0 THEN NULL ELSE p_type END AS delay_reason,
  CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_size * 100 END AS units_planned
FROM part""",
    "fx_notifications": """
SELECT event_id AS notification_id, user_id, upper(event_type) AS title, props AS message,
  event_type IN ('purchase', 'signup') AS read, ts AS created_at
FROM events""",
    "fx_active": "SELECT * FROM fx_alerts WHERE status IN ('pending', 'escalated')",
    "fx_open_tickets": "SELECT * FROM fx_tickets WHERE status NOT IN ('closed', 'reviewed')",
    "fx_latest_reading": """
SELECT * FROM fx_readings QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY ts DESC, reading_id DESC) = 1""",
    "fx_latest_prediction": """
SELECT * FROM fx_predictions QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY ts DESC, prediction_id DESC) = 1""",
    "fx_risk": """
SELECT m.machine_id, m.name AS machine_name, location, risk_level, health_score,
  floor(rul_hours * 10 + 0.5) / 10 AS rul_hours, coalesce(n, 0) AS open_tickets
FROM fx_machines m LEFT JOIN (SELECT machine_id, count(*) AS n FROM fx_open_tickets GROUP BY machine_id) t
  ON m.machine_id = t.machine_id WHERE status <> 'maintenance'""",
    "fx_impact": """
SELECT machine_id, name AS machine_name,
  floor(greatest(0, (100 - health_score) / 10) * 4 * 10 + 0.5) / 10 AS downtime_hours,
  floor(greatest(0, (100 - health_score) * 0.2E0) * 10 + 0.5) / 10 AS production_loss_percent, risk_level
FROM fx_machines""",
}


def with_views(sql: str) -> str:
    """The query with the views it names, and those they name, in front."""
    needed: set[str] = set()
    open_texts = [sql]
    while open_texts:
        for name in re.findall(r"\bfx_\w+", open_texts.pop()):
            if name in VIEWS and name not in needed:
                needed.add(name)
                open_texts.append(VIEWS[name])
    views = [f"{name} AS ({text.strip()})" for name, text in VIEWS.items() if name in needed]
    body = sql.strip()
    if not views:
        return body
    for opening in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(opening):
            return opening + ",\n".join(views) + ",\n" + body[len(opening):]
    return "WITH " + ",\n".join(views) + "\n" + body
