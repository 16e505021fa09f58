"""Queries of table changes. The change sets are derived from whole tables, one change per row."""

from __future__ import annotations

from pyspark.sql import functions as F

from millwatch.operators import access, admin, alerts, changes, production, tickets
from millwatch.plans.registry import query

MOVED_AT = "2001-12-01 00:00:00"


def _last(value: str, kinds: str, source: str = "ev", key: str = "k") -> str:
    """The latest value per key among the changes of some kinds, nulls included."""
    return f"""(SELECT {key} AS k, {value} AS v FROM {source} WHERE {kinds}
      QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY event_id DESC) = 1)"""


# ---------------------------------------------------------------- M1


def machine_changes(d):
    """Each event changes its machine; the kind of event says which columns it states."""
    return d.stored("events").selectExpr(
        "user_id AS machine_id", "event_id AS seq",
        "'Bay ' || CAST(event_id % 50 AS STRING) AS location",
        "CAST(event_id % 100 AS DOUBLE) AS health_score",
        "CASE WHEN event_id % 2 = 0 THEN 'normal' ELSE 'offline' END AS status",
        "CASE WHEN event_type = 'signup' THEN (event_id % 10) * 6 END AS assigned_operator_id",
        """CASE event_type WHEN 'view' THEN array('status') WHEN 'click' THEN array('location')
           WHEN 'purchase' THEN array('status', 'health_score') ELSE array('assigned_operator_id') END AS _set""",
    )


@query(
    "m1_apply_changes",
    f"""WITH ev AS (SELECT user_id AS k, * FROM events)
        SELECT m.machine_id, m.name, CASE WHEN l.k IS NULL THEN m.location ELSE l.v END AS location,
          CASE WHEN h.k IS NULL THEN m.health_score ELSE h.v END AS health_score, CASE WHEN s.k IS NULL THEN m.status ELSE s.v END AS status,
          CASE WHEN o.k IS NULL THEN m.assigned_operator_id ELSE o.v END AS assigned_operator_id
        FROM fx_machines m
        LEFT JOIN {_last("'Bay ' || CAST(event_id % 50 AS VARCHAR)", "event_type = 'click'")} l ON l.k = m.machine_id
        LEFT JOIN {_last("CAST(event_id % 100 AS DOUBLE)", "event_type = 'purchase'")} h ON h.k = m.machine_id
        LEFT JOIN {_last("CASE WHEN event_id % 2 = 0 THEN 'normal' ELSE 'offline' END", "event_type IN ('view', 'purchase')")} s ON s.k = m.machine_id
        LEFT JOIN {_last("CASE WHEN event_type = 'signup' THEN (event_id % 10) * 6 END", "event_type IN ('signup', 'error')")} o ON o.k = m.machine_id""",
)
def m1(d):
    after = changes.apply_changes(d.machines(), machine_changes(d), "machine_id")
    return after.select("machine_id", "name", "location", "health_score", "status", "assigned_operator_id")


# ---------------------------------------------------------------- M2


def ticket_changes(d):
    """Two changes per ticket, one for each pair of events."""
    return d.stored("events").selectExpr(
        "CAST(floor(event_id / 2) AS BIGINT) AS ticket_id", "event_id AS seq", "user_id AS changed_by", "ts AS changed_at",
        "CASE event_type WHEN 'view' THEN 'in_progress' WHEN 'signup' THEN 'reviewed' WHEN 'purchase' THEN 'closed' END AS status",
        "CASE WHEN event_type = 'click' THEN user_id END AS mechanic_id",
        "CASE WHEN event_type = 'signup' THEN CAST(value AS DECIMAL(18,2)) END AS repair_cost",
        """CASE event_type WHEN 'click' THEN array('mechanic_id') WHEN 'error' THEN array('mechanic_id')
           WHEN 'signup' THEN array('status', 'repair_cost') ELSE array('status') END AS _set""",
    )


CHANGE = """ev AS (SELECT event_id // 2 AS k, *, CASE event_type WHEN 'view' THEN 'in_progress' WHEN 'signup' THEN 'reviewed'
  WHEN 'purchase' THEN 'closed' END AS st FROM events)"""


@query(
    "m2_tickets",
    f"""WITH {CHANGE}
        SELECT t.ticket_id, CASE WHEN s.k IS NULL THEN t.status ELSE s.v END AS status,
          CASE WHEN m.k IS NULL THEN t.mechanic_id ELSE m.v END AS mechanic_id,
          CAST(CASE WHEN c.k IS NULL THEN t.repair_cost ELSE c.v END AS DOUBLE) AS repair_cost,
          CASE WHEN e.k IS NULL THEN t.closed_at ELSE e.v END AS closed_at
        FROM fx_tickets t
        LEFT JOIN {_last("st", "st IS NOT NULL")} s ON s.k = t.ticket_id
        LEFT JOIN {_last("CASE WHEN event_type = 'click' THEN user_id END", "event_type IN ('click', 'error')")} m ON m.k = t.ticket_id
        LEFT JOIN {_last("CAST(value AS DECIMAL(18,2))", "event_type = 'signup'")} c ON c.k = t.ticket_id
        LEFT JOIN {_last("ts", "event_type = 'purchase'")} e ON e.k = t.ticket_id""",
)
def m2(d):
    after = tickets.update_tickets(d.tickets(), ticket_changes(d))[0]
    return after.select("ticket_id", "status", "mechanic_id", "repair_cost", "closed_at")


@query(
    "m2_cost_rows",
    f"""WITH {CHANGE}
        SELECT md5(CAST(k AS VARCHAR) || '|' || CAST(event_id AS VARCHAR) || '|cost') AS cost_id, k AS ticket_id, machine_id,
          CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) AS amount, month(ts) AS month, year(ts) AS year, user_id AS approved_by, ts AS created_at
        FROM ev JOIN fx_tickets t ON t.ticket_id = ev.k WHERE event_type = 'signup'""",
)
def m2_cost(d):
    return tickets.update_tickets(d.tickets(), ticket_changes(d))[1]


@query(
    "m2_audit_rows",
    f"""WITH {CHANGE}
        SELECT md5(CAST(k AS VARCHAR) || '|' || CAST(event_id AS VARCHAR) || '|audit') AS log_id, user_id, 'UPDATE_TICKET' AS action, k AS entity_id,
          CASE event_type WHEN 'click' THEN '{{"mechanic_id":"' || CAST(user_id AS VARCHAR) || '"}}' WHEN 'error' THEN '{{"mechanic_id":null}}'
            WHEN 'signup' THEN '{{"status":"reviewed","repair_cost":"' || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) || '"}}'
            ELSE '{{"status":"' || st || '"}}' END AS new_value, ts AS "timestamp"
        FROM ev JOIN fx_tickets t ON t.ticket_id = ev.k""",
)
def m2_audit(d):
    audit = tickets.update_tickets(d.tickets(), ticket_changes(d))[2]
    return audit.select("log_id", "user_id", "action", "entity_id", "new_value", "timestamp")


# ---------------------------------------------------------------- M3


def actions(d):
    """Five life-cycle steps per ticket."""
    words = "array('assign', 'accept', 'reject', 'start', 'pause', 'resume', 'report', 'review', 'close')"
    return d.stored("events").selectExpr(
        "CAST(floor(event_id / 5) AS BIGINT) AS ticket_id", "event_id AS seq", f"element_at({words}, CAST(event_id % 9 AS INT) + 1) AS action",
        "(event_id % 17) * 6 + 1 AS mechanic_id", "user_id AS manager_id", "user_id AS changed_by", "ts AS changed_at",
        "props AS repair_report", "event_type AS parts_used",
        "CAST(event_id % 40 AS DOUBLE) / 4 AS time_taken_hours", "CAST(value AS DECIMAL(18,2)) AS repair_cost",
    )


def wide_tickets(d):
    """Tickets with the columns that the repair report fills."""
    return d.tickets().withColumns(
        {
            "manager_id": F.lit(None).cast("bigint"), "repair_report": F.lit(None).cast("string"),
            "parts_used": F.lit(None).cast("string"), "time_taken_hours": F.col("time_taken_hours").cast("double"),
        }
    )


STEP = """ev AS (SELECT event_id // 5 AS k, (event_id % 17) * 6 + 1 AS mech, *, CASE event_id % 9 WHEN 0 THEN 'assign' WHEN 1 THEN 'accept'
    WHEN 2 THEN 'reject' WHEN 3 THEN 'start' WHEN 4 THEN 'pause' WHEN 5 THEN 'resume' WHEN 6 THEN 'report' WHEN 7 THEN 'review' ELSE 'close' END AS word,
  CASE event_id % 9 WHEN 0 THEN 'assigned' WHEN 1 THEN 'accepted' WHEN 2 THEN 'open' WHEN 3 THEN 'in_progress' WHEN 4 THEN 'paused'
    WHEN 5 THEN 'in_progress' WHEN 6 THEN 'repaired' WHEN 7 THEN 'reviewed' ELSE 'closed' END AS st FROM events)"""


@query(
    "m3_tickets",
    f"""WITH {STEP}
        SELECT t.ticket_id, CASE WHEN s.k IS NULL THEN t.status ELSE s.v END AS status,
          CASE WHEN m.k IS NULL THEN t.mechanic_id ELSE m.v END AS mechanic_id, a.v AS manager_id, r.v AS repair_report, p.v AS parts_used,
          CASE WHEN h.k IS NULL THEN CAST(t.time_taken_hours AS DOUBLE) ELSE h.v END AS time_taken_hours,
          CAST(CASE WHEN c.k IS NULL THEN t.repair_cost ELSE c.v END AS DOUBLE) AS repair_cost,
          CASE WHEN e.k IS NULL THEN t.closed_at ELSE e.v END AS closed_at
        FROM fx_tickets t
        LEFT JOIN {_last("st", "true")} s ON s.k = t.ticket_id
        LEFT JOIN {_last("CASE WHEN word = 'assign' THEN mech END", "word IN ('assign', 'reject')")} m ON m.k = t.ticket_id
        LEFT JOIN {_last("user_id", "word = 'assign'")} a ON a.k = t.ticket_id
        LEFT JOIN {_last("props", "word = 'report'")} r ON r.k = t.ticket_id
        LEFT JOIN {_last("event_type", "word = 'report'")} p ON p.k = t.ticket_id
        LEFT JOIN {_last("CAST(event_id % 40 AS DOUBLE) / 4", "word = 'report'")} h ON h.k = t.ticket_id
        LEFT JOIN {_last("CAST(value AS DECIMAL(18,2))", "word = 'review'")} c ON c.k = t.ticket_id
        LEFT JOIN {_last("ts", "word = 'close'")} e ON e.k = t.ticket_id""",
)
def m3(d):
    after = tickets.ticket_transitions(wide_tickets(d), d.mechanics(), actions(d))["tickets"]
    return after.select(
        "ticket_id", "status", "mechanic_id", "manager_id", "repair_report", "parts_used", "time_taken_hours", "repair_cost", "closed_at"
    )


@query(
    "m3_mechanics",
    f"""WITH {STEP}
        SELECT m.mechanic_id, CASE WHEN s.k IS NULL THEN m.login_status ELSE s.v END AS login_status,
          CASE WHEN a.k IS NULL THEN m.current_assignment_id ELSE a.v END AS current_assignment_id
        FROM fx_mechanics m
        LEFT JOIN {_last("CASE WHEN word = 'assign' THEN 'busy' ELSE 'available' END", "word IN ('assign', 'reject', 'report')", key="mech")} s ON s.k = m.mechanic_id
        LEFT JOIN {_last("CASE WHEN word = 'assign' THEN k END", "word IN ('assign', 'reject', 'report')", key="mech")} a ON a.k = m.mechanic_id""",
)
def m3_mechanics(d):
    after = tickets.ticket_transitions(wide_tickets(d), d.mechanics(), actions(d))["mechanics"]
    return after.select("mechanic_id", "login_status", "current_assignment_id")


# ---------------------------------------------------------------- M4


def answers(d):
    """Every event answers an alert; three events in a row answer the same one."""
    return d.stored("events").selectExpr(
        "event_id - event_id % 3 AS alert_id", "event_id AS seq", "user_id AS operator_id", "props AS description", "ts AS responded_at",
        "CASE WHEN event_type IN ('purchase', 'signup') THEN 'reported' ELSE 'ignored' END AS response",
    )


ANSWER = """ans AS (SELECT event_id - event_id % 3 AS aid, *, CASE WHEN event_type IN ('purchase', 'signup') THEN 'reported' ELSE 'ignored' END AS resp,
  row_number() OVER (PARTITION BY event_id - event_id % 3 ORDER BY event_id) AS nth FROM events)"""


@query(
    "m4_alerts",
    f"""WITH {ANSWER}
        SELECT a.alert_id, CASE WHEN ans.aid IS NOT NULL AND status IN ('pending', 'escalated') THEN 'acknowledged' ELSE status END AS status,
          CASE WHEN ans.aid IS NOT NULL AND status IN ('pending', 'escalated') THEN resp ELSE operator_response END AS operator_response
        FROM fx_alerts a LEFT JOIN ans ON ans.aid = a.alert_id AND nth = 1""",
)
def m4(d):
    return alerts.respond_alerts(d.alerts(), answers(d))[0].select("alert_id", "status", "operator_response")


@query(
    "m4_rejected",
    f"""WITH {ANSWER}
        SELECT event_id AS seq, aid AS alert_id, CASE WHEN a.alert_id IS NULL THEN 'alert not found' ELSE 'alert not actionable' END AS reason
        FROM ans LEFT JOIN fx_alerts a ON ans.aid = a.alert_id
        WHERE a.alert_id IS NULL OR status NOT IN ('pending', 'escalated') OR nth > 1""",
)
def m4_rejected(d):
    return alerts.respond_alerts(d.alerts(), answers(d))[1].select("seq", "alert_id", "reason")


@query(
    "m4_tickets",
    f"""WITH {ANSWER}
        SELECT md5(CAST(aid AS VARCHAR) || '|ticket') AS ticket_id, machine_id, aid AS alert_id, user_id AS operator_id, 'open' AS status,
          props AS description, false AS escalated, ts AS created_at
        FROM ans JOIN fx_alerts a ON ans.aid = a.alert_id WHERE status IN ('pending', 'escalated') AND nth = 1 AND resp = 'reported'""",
)
def m4_tickets(d):
    return alerts.respond_alerts(d.alerts(), answers(d))[2]


# ---------------------------------------------------------------- M5


def moves(d):
    """One move per part between machines found by its number; some machines do not exist."""
    return d.stored("part").selectExpr(
        "p_partkey AS move_id", "p_partkey AS seq", "(p_partkey * 3) % 1700 AS source", "(p_partkey * 11 + 5) % 1700 AS target",
        "CAST(p_size AS BIGINT) AS user_id", f"CAST('{MOVED_AT}' AS TIMESTAMP_NTZ) AS moved_at",
    )


MOVE = f"""mv AS (SELECT p_partkey AS move_id, s.machine_id AS source, s.name AS source_name, t.machine_id AS target, t.name AS target_name,
    CAST(p_size AS BIGINT) AS user_id, TIMESTAMP '{MOVED_AT}' AS moved_at
    FROM part JOIN fx_machines s ON s.machine_id = (p_partkey * 3) % 1700 JOIN fx_machines t ON t.machine_id = (p_partkey * 11 + 5) % 1700),
  first_mv AS (SELECT * FROM mv QUALIFY row_number() OVER (PARTITION BY source ORDER BY move_id) = 1)"""


def _reallocated(d, part):
    return production.reallocate(d.machines(), d.schedules(), d.tickets(), moves(d))[part]


@query(
    "m5_machines",
    f"WITH {MOVE} SELECT machine_id, CASE WHEN machine_id IN (SELECT source FROM mv) THEN 'maintenance' ELSE status END AS status FROM fx_machines",
)
def m5(d):
    return _reallocated(d, "machines").select("machine_id", "status")


@query(
    "m5_schedules",
    f"""WITH RECURSIVE {MOVE},
  hop AS (SELECT a.move_id, min(b.move_id) AS next_id FROM mv a JOIN mv b ON b.source = a.target AND b.move_id > a.move_id GROUP BY a.move_id),
  walk AS (SELECT schedule_id, move_id FROM fx_schedules JOIN first_mv ON source = machine_id
    UNION ALL SELECT schedule_id, next_id FROM walk JOIN hop USING (move_id)),
  ended AS (SELECT schedule_id, max(move_id) AS move_id FROM walk GROUP BY schedule_id)
SELECT s.schedule_id, coalesce(target, machine_id) AS machine_id, CASE WHEN target IS NULL THEN status ELSE 'on_track' END AS status,
          CASE WHEN target IS NULL THEN delay_reason ELSE 'Reallocated from ' || source_name END AS delay_reason
        FROM fx_schedules s LEFT JOIN ended e ON e.schedule_id = s.schedule_id LEFT JOIN mv ON mv.move_id = e.move_id""",
)
def m5_schedules(d):
    return _reallocated(d, "schedules").select("schedule_id", "machine_id", "status", "delay_reason")


@query(
    "m5_tickets",
    f"""WITH {MOVE} SELECT source AS machine_id, user_id AS operator_id, 'open' AS status,
          'Auto-generated: Machine load reallocated to ' || target_name || '. Maintenance required.' AS description, moved_at AS created_at
        FROM first_mv WHERE source NOT IN (SELECT machine_id FROM fx_open_tickets)""",
)
def m5_tickets(d):
    return _reallocated(d, "tickets").select("machine_id", "operator_id", "status", "description", "created_at")


@query(
    "m5_audit_rows",
    f"""WITH {MOVE} SELECT md5(CAST(move_id AS VARCHAR) || '|audit') AS log_id, user_id, 'REALLOCATE_LOAD' AS action, 'Production' AS entity_type,
          source AS entity_id, 'Production reallocated from ' || source_name || ' to ' || target_name AS new_value, moved_at AS "timestamp",
          '127.0.0.1' AS ip_address FROM mv""",
)
def m5_audit(d):
    return _reallocated(d, "audit_rows")


@query(
    "m5_notifications",
    f"""WITH {MOVE} SELECT md5(CAST(move_id AS VARCHAR) || '|notice') AS notification_id, user_id, 'Load Reallocated' AS title,
          'Production shifted from ' || source_name || ' to ' || target_name || '.' AS message, false AS read, moved_at AS created_at FROM mv""",
)
def m5_notifications(d):
    return _reallocated(d, "notifications")


@query(
    "m5_rejected",
    f"""WITH {MOVE} SELECT p_partkey AS move_id, (p_partkey * 3) % 1700 AS source, (p_partkey * 11 + 5) % 1700 AS target,
          'Machine not found' AS reason FROM part WHERE p_partkey NOT IN (SELECT move_id FROM mv)""",
)
def m5_rejected(d):
    return _reallocated(d, "rejected")


# ---------------------------------------------------------------- M6 to M9


@query(
    "m6_mechanics",
    f"""WITH ev AS (SELECT (event_id % 20) * 6 + 1 AS k, * FROM events)
        SELECT m.mechanic_id, CASE WHEN s.k IS NULL THEN m.login_status ELSE s.v END AS login_status,
          CASE WHEN a.k IS NULL THEN m.current_assignment_id ELSE a.v END AS current_assignment_id, m.shift
        FROM fx_mechanics m
        LEFT JOIN {_last("CASE event_type WHEN 'view' THEN 'busy' WHEN 'error' THEN 'offline' ELSE 'available' END", "event_type <> 'click'")} s ON s.k = m.mechanic_id
        LEFT JOIN {_last("CASE WHEN event_type = 'view' THEN event_id END", "event_type IN ('view', 'purchase')")} a ON a.k = m.mechanic_id""",
)
def m6(d):
    stated = d.stored("events").selectExpr(
        "(event_id % 20) * 6 + 1 AS mechanic_id", "event_id AS seq",
        "CASE event_type WHEN 'view' THEN 'busy' WHEN 'error' THEN 'offline' ELSE 'available' END AS login_status",
        "CASE WHEN event_type = 'view' THEN event_id END AS current_assignment_id",
        """CASE WHEN event_type IN ('view', 'purchase') THEN array('login_status', 'current_assignment_id')
           WHEN event_type = 'click' THEN CAST(array() AS ARRAY<STRING>) ELSE array('login_status') END AS _set""",
    )
    return admin.update_mechanics(d.mechanics(), stated).select("mechanic_id", "login_status", "current_assignment_id", "shift")


@query(
    "m7_deactivated_users",
    """SELECT user_id, name, is_active AND user_id NOT IN (SELECT p_partkey FROM part WHERE p_size <= 10) AS is_active FROM fx_users""",
)
def m7_deactivate(d):
    gone = d.stored("part").filter("p_size <= 10").selectExpr("p_partkey AS user_id")
    return admin.deactivate_users(d.users(), gone).select("user_id", "name", "is_active")


def new_users(d):
    """Two sign-ups for each pair of customers, at the address of a supplier with the pair's number."""
    return d.stored("customer").selectExpr(
        "1000000 + c_custkey AS user_id", "c_name AS name",
        "'supplier.' || lpad(CAST(CAST(floor(c_custkey / 2) AS BIGINT) AS STRING), 9, '0') || '@example.com' AS email",
        "CASE WHEN c_custkey % 4 < 2 THEN 'mechanic' ELSE 'operator' END AS role", "true AS is_active",
    )


SIGN_UP = """su AS (SELECT 1000000 + c_custkey AS user_id, c_name AS name, 'supplier.' || lpad(CAST(c_custkey // 2 AS VARCHAR), 9, '0')
  || '@example.com' AS email, CASE WHEN c_custkey % 4 < 2 THEN 'mechanic' ELSE 'operator' END AS role FROM customer),
  added AS (SELECT * FROM su WHERE email NOT IN (SELECT email FROM fx_users)
    QUALIFY row_number() OVER (PARTITION BY email ORDER BY user_id) = 1)"""


@query(
    "m7_created_users",
    f"WITH {SIGN_UP} SELECT user_id, name, email, role FROM fx_users UNION ALL SELECT user_id, name, email, role FROM added",
)
def m7_create(d):
    return admin.create_users(d.users(), d.mechanics(), new_users(d), ["user_id"])[0].select("user_id", "name", "email", "role")


@query(
    "m7_created_mechanics",
    f"""WITH {SIGN_UP} SELECT mechanic_id, skill_type, login_status FROM fx_mechanics
        UNION ALL SELECT user_id, NULL, 'offline' FROM added WHERE role = 'mechanic'""",
)
def m7_mechanics(d):
    return admin.create_users(d.users(), d.mechanics(), new_users(d), ["user_id"])[1].select("mechanic_id", "skill_type", "login_status")


@query(
    "m7_rejected_users",
    f"WITH {SIGN_UP} SELECT user_id, email, 'Email already registered' AS reason FROM su WHERE user_id NOT IN (SELECT user_id FROM added)",
)
def m7_rejected(d):
    return admin.create_users(d.users(), d.mechanics(), new_users(d), ["user_id"])[2].select("user_id", "email", "reason")


@query(
    "m8_schedules",
    """WITH ch AS (SELECT o_custkey AS k, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'on_track' WHEN 'O' THEN 'delayed' ELSE 'halted' END AS st,
           CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS reason FROM orders),
         s AS (SELECT * FROM ch QUALIFY row_number() OVER (PARTITION BY k ORDER BY o_orderkey DESC) = 1),
         r AS (SELECT * FROM ch WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY o_orderkey DESC) = 1)
       SELECT schedule_id, coalesce(s.st, status) AS status, coalesce(r.reason, delay_reason) AS delay_reason
       FROM fx_schedules LEFT JOIN s ON s.k = schedule_id LEFT JOIN r ON r.k = schedule_id""",
)
def m8(d):
    stated = d.stored("orders").selectExpr(
        "o_custkey AS schedule_id", "o_orderkey AS seq",
        "CASE o_orderstatus WHEN 'F' THEN 'on_track' WHEN 'O' THEN 'delayed' ELSE 'halted' END AS status",
        "CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS delay_reason",
    )
    return production.update_schedules(d.schedules(), stated).select("schedule_id", "status", "delay_reason")


@query("m9_mark_read", "SELECT notification_id, user_id, read OR title = 'CLICK' AS read FROM fx_notifications")
def m9(d):
    clicked = d.notifications().filter(F.col("title") == "CLICK").select("notification_id")
    return admin.mark_read(d.notifications(), clicked).select("notification_id", "user_id", "read")


@query("m9_mark_all_read", "SELECT notification_id, user_id, true AS read FROM fx_notifications")
def m9_all(d):
    return admin.mark_read(d.notifications()).select("notification_id", "user_id", "read")


@query(
    "p4_changed_unknown",
    "SELECT DISTINCT (event_id % 20) * 6 + 1 AS mechanic_id FROM events WHERE (event_id % 20) * 6 + 1 NOT IN (SELECT mechanic_id FROM fx_mechanics)",
)
def p4_unknown(d):
    """Mechanics that changes name and the table lacks."""
    named = d.stored("events").selectExpr("(event_id % 20) * 6 + 1 AS mechanic_id")
    return access.lookup(d.mechanics(), named, "mechanic_id")[1]
