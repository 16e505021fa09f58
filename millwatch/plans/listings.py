"""Queries of scans, checks, filters, look-ups, pages and work lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from millwatch.functions import health
from millwatch.operators import access, admin, alerts, assets, events, paging, production, tickets, trigrams, validate
from millwatch.plans.registry import query
from millwatch.sources.tables import conform, read_readings, write_readings
from millwatch.session import new_folder

AS_OF = "2024-01-31 00:00:00"

# ---------------------------------------------------------------- sources and checks


def _scan(name, build, sql):
    @query(f"s1_scan_{name}", sql)
    def scan(d):
        return conform(build(d), name)


def _text(*columns):
    return ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in columns)


_scan(
    "machines", lambda d: d.machines(),
    f"""SELECT {_text('machine_id')}, name, location, type, {_text('assigned_operator_id')}, health_score, risk_level,
        rul_hours, status, CAST(NULL AS TIMESTAMP) AS last_updated FROM fx_machines""",
)
_scan(
    "sensor_readings", lambda d: d.readings(),
    f"""SELECT {_text('reading_id', 'machine_id')}, ts AS "timestamp", temperature, vibration, pressure,
        current_a AS "current", rpm, noise_level FROM fx_readings""",
)
_scan(
    "ml_predictions", lambda d: d.predictions(),
    f"""SELECT {_text('prediction_id', 'machine_id')}, ts AS "timestamp", health_score, risk_level, rul_hours,
        failure_type, confidence, 'v1.0.0-sim' AS model_version FROM fx_predictions""",
)
_scan(
    "alerts", lambda d: d.alerts(),
    f"""SELECT {_text('alert_id', 'machine_id')}, triggered_at, severity, status, operator_response,
        false AS auto_escalated, CAST(NULL AS TIMESTAMP) AS escalated_at FROM fx_alerts""",
)
_scan(
    "tickets", lambda d: d.tickets(),
    f"""SELECT {_text('ticket_id', 'machine_id')}, CAST(NULL AS VARCHAR) AS alert_id, {_text('operator_id', 'mechanic_id')},
        CAST(NULL AS VARCHAR) AS manager_id, status, description, CAST(NULL AS VARCHAR) AS photo_url,
        CAST(NULL AS VARCHAR) AS voice_note_url, CAST(repair_cost AS DOUBLE) AS repair_cost,
        CAST(NULL AS VARCHAR) AS repair_report, CAST(NULL AS VARCHAR) AS parts_used,
        CAST(time_taken_hours AS DOUBLE) AS time_taken_hours, escalated, created_at, closed_at FROM fx_tickets""",
)
_scan(
    "cost_logs", lambda d: d.cost_logs(),
    f"""SELECT CAST(NULL AS VARCHAR) AS cost_id, {_text('ticket_id', 'machine_id')}, CAST(amount AS DOUBLE) AS amount,
        CAST(month AS BIGINT) AS month, CAST(year AS BIGINT) AS year, {_text('approved_by')},
        CAST(NULL AS TIMESTAMP) AS created_at FROM fx_cost_logs""",
)
_scan(
    "users", lambda d: d.users(),
    f"SELECT {_text('user_id')}, name, email, role, is_active, CAST(NULL AS TIMESTAMP) AS created_at FROM fx_users",
)
_scan(
    "mechanics", lambda d: d.mechanics(),
    f"""SELECT {_text('mechanic_id')}, skill_type, login_status, {_text('current_assignment_id')}, shift,
        CAST(NULL AS VARCHAR) AS contact FROM fx_mechanics""",
)
_scan(
    "audit_logs", lambda d: d.audit_logs(),
    f"""SELECT {_text('log_id', 'user_id')}, action, entity_type, {_text('entity_id')}, CAST(NULL AS VARCHAR) AS old_value,
        new_value, ts AS "timestamp", '127.0.0.1' AS ip_address FROM fx_audit_logs""",
)
_scan(
    "production_schedules", lambda d: d.schedules(),
    f"""SELECT {_text('schedule_id', 'machine_id')}, product, CAST(NULL AS TIMESTAMP) AS start_time,
        CAST(NULL AS TIMESTAMP) AS end_time, status, delay_reason, CAST(coalesce(units_planned, 1000) AS BIGINT) AS units_planned
        FROM fx_schedules""",
)
_scan(
    "notifications", lambda d: d.notifications(),
    f"SELECT {_text('notification_id', 'user_id')}, title, message, read, created_at FROM fx_notifications",
)


def raw_readings(d):
    """Readings as untyped text, with what senders get wrong: errors send no number, some sign-ups no machine."""
    return d.stored("events").selectExpr(
        "CAST(event_id AS STRING) AS reading_id",
        "CASE WHEN event_type = 'signup' AND event_id % 2 = 0 THEN NULL ELSE CAST(user_id AS STRING) END AS machine_id",
        "CAST(ts AS STRING) AS timestamp",
        "CASE WHEN event_type = 'error' THEN 'n/a' ELSE CAST(event_id % 60 AS STRING) END AS temperature",
        "CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN NULL ELSE '0.5' END AS vibration",
        "'4' AS pressure", "'12.5' AS current", "'1800' AS rpm", "CAST(55 + (event_id % 45) AS STRING) AS noise_level",
    )


RAW = """SELECT event_id, event_type = 'signup' AND event_id % 2 = 0 AS no_machine, event_type = 'error' AS bad_number,
  event_type = 'error' AND event_id % 3 = 0 AS no_vibration, * EXCLUDE (event_id) FROM events"""


@query(
    "s3_valid",
    f"""SELECT CAST(event_id AS VARCHAR) AS reading_id, CAST(user_id AS VARCHAR) AS machine_id, ts AS "timestamp",
          CAST(event_id % 60 AS DOUBLE) AS temperature, 0.5E0 AS vibration, 4E0 AS pressure, 12.5E0 AS "current", 1800E0 AS rpm,
          CAST(55 + (event_id % 45) AS DOUBLE) AS noise_level
        FROM ({RAW}) WHERE NOT no_machine AND NOT bad_number""",
)
def s3_valid(d):
    return validate.validate(raw_readings(d), validate.SPECS["sensor_readings"])[0]


@query(
    "s3_rejected",
    f"""SELECT CAST(event_id AS VARCHAR) AS reading_id, concat_ws('; ', CASE WHEN no_machine THEN 'machine_id: missing' END,
          CASE WHEN no_vibration THEN 'vibration: missing' END, CASE WHEN bad_number THEN 'temperature: not double' END) AS problems
        FROM ({RAW}) WHERE no_machine OR bad_number""",
)
def s3_rejected(d):
    rejected = validate.validate(raw_readings(d), validate.SPECS["sensor_readings"])[1]
    return rejected.select("reading_id", F.array_join("problems", "; ").alias("problems"))


@query(
    "s3_schedule_domain",
    """SELECT schedule_id, CASE WHEN status IN ('on_track', 'delayed', 'halted', 'cancelled', 'at_risk') THEN '' ELSE 'status: not allowed' END
         AS problems FROM (SELECT schedule_id, CASE WHEN status = 'halted' THEN 'completed' ELSE status END AS status FROM fx_schedules)""",
)
def s3_domain(d):
    foreign = d.schedules().withColumn("status", F.when(F.col("status") == "halted", "completed").otherwise(F.col("status")))
    checked = validate.with_problems(foreign, validate.SPECS["production_schedules"])
    return checked.select("schedule_id", F.array_join("problems", "; ").alias("problems"))


@query(
    "s4_known_readings",
    "SELECT reading_id, machine_id, ts AS \"timestamp\" FROM fx_readings WHERE machine_id IN (SELECT machine_id FROM fx_machines)",
)
def s4_known(d):
    """Every machine counts, whatever its status; the test readings are all of known ones."""
    return validate.reject_orphans(d.readings(), d.machines())[0].select("reading_id", "machine_id", "timestamp")


@query("s4_orphan_schedules", "SELECT schedule_id, machine_id FROM fx_schedules WHERE machine_id NOT IN (SELECT machine_id FROM fx_machines)")
def s4_orphans(d):
    return validate.reject_orphans(d.schedules(), d.machines())[1].select("schedule_id", "machine_id")


@query(
    "s5_with_defaults",
    f"""SELECT coalesce(rid, md5(CAST(user_id AS VARCHAR) || '|' || strftime(t, '%Y-%m-%d %H:%M:%S') || '|'
              || CAST(temp AS VARCHAR) || '|' || CAST(vib AS VARCHAR))) AS reading_id,
          user_id AS machine_id, t AS "timestamp", temp AS temperature, vib AS vibration
        FROM (SELECT CASE WHEN event_type = 'view' THEN NULL ELSE CAST(event_id AS VARCHAR) END AS rid, user_id,
                CASE WHEN event_type IN ('view', 'click') THEN TIMESTAMP '{AS_OF}' ELSE ts END AS t,
                CAST(event_id % 60 AS DOUBLE) AS temp, CAST(event_id AS DOUBLE) AS vib FROM events)""",
)
def s5(d):
    sent = d.stored("events").selectExpr(
        "CASE WHEN event_type <> 'view' THEN event_id END AS reading_id",
        "CASE WHEN event_type <> 'click' THEN user_id END AS machine_id", "user_id AS _address",
        "CASE WHEN event_type NOT IN ('view', 'click') THEN ts END AS timestamp",
        "CAST(CAST(event_id % 60 AS DOUBLE) AS DOUBLE) AS temperature", "CAST(event_id AS DOUBLE) AS vibration",
    )
    return validate.with_defaults(sent, AS_OF, "_address").drop("_address")


SUPPLIER_MAIL = "'supplier.' || lpad(CAST({key} AS {text}), 9, '0') || '@example.com'"
INCOMING = "SELECT l_partkey AS user_id, " + SUPPLIER_MAIL.format(key="l_partkey", text="VARCHAR") + " AS email FROM lineitem"


@query(
    "s6_inserted",
    f"""SELECT DISTINCT user_id, email FROM ({INCOMING}) i WHERE email NOT IN (SELECT email FROM fx_users)""",
)
def s6_inserted(d):
    return validate.insert_if_absent(d.users(), _incoming(d), "email", ["user_id", "line"])[0].select("user_id", "email")


@query(
    "s6_skipped",
    f"""SELECT email, count(*) - CASE WHEN email IN (SELECT email FROM fx_users) THEN 0 ELSE 1 END AS copies
        FROM ({INCOMING}) i GROUP BY email HAVING copies > 0""",
)
def s6_skipped(d):
    """Of order lines alone, without the line's number: copies that tie in the order are told apart by number."""
    lines = _incoming(d).select("user_id", "email")
    rest = validate.insert_if_absent(d.users(), lines, "email", ["user_id"])[1]
    return rest.groupBy("email").agg(F.count("*").alias("copies"))


@query(
    "s6_null_keys",
    f"""SELECT l_partkey AS user_id, l_orderkey AS order_id FROM lineitem WHERE l_linenumber = 1""",
)
def s6_null_keys(d):
    """Rows without a key are never inserted; here the first line of each order has none."""
    lines = d.stored("lineitem").selectExpr(
        "l_partkey AS user_id", "l_orderkey AS order_id", "l_linenumber AS line",
        "CASE WHEN l_linenumber > 1 THEN 'line.' || CAST(l_orderkey AS STRING) || '.' || CAST(l_linenumber AS STRING) END AS email",
    )
    rest = validate.insert_if_absent(d.users(), lines, "email", ["order_id", "line"])[1]
    return rest.filter("email IS NULL").select("user_id", "order_id")


def _incoming(d):
    """One sign-up per order line under the address of its part number."""
    return d.stored("lineitem").selectExpr(
        "l_partkey AS user_id", SUPPLIER_MAIL.format(key="l_partkey", text="STRING") + " AS email",
        "l_orderkey * 8 + l_linenumber AS line",
    )


UUID = "substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || substr({h}, 17, 4) || '-' || substr({h}, 21, 12)"


@query(
    "s7_normalize_ids",
    "SELECT o_orderkey AS ticket_id, md5(CAST(o_custkey AS VARCHAR)) AS machine_id, CASE WHEN o_orderkey % 8 <> 0 THEN md5(CAST(o_orderkey AS VARCHAR)) END AS mechanic_id FROM orders",
)
def s7(d):
    ids = d.stored("orders").selectExpr(
        "o_orderkey AS ticket_id", UUID.format(h="md5(CAST(o_custkey AS STRING))") + " AS machine_id",
        "CASE WHEN o_orderkey % 8 <> 0 THEN " + UUID.format(h="md5(CAST(o_orderkey AS STRING))") + " END AS mechanic_id",
    )
    return validate.normalize_ids(ids, ["machine_id", "mechanic_id"])


@query(
    "s8_partitioned_readings",
    """SELECT reading_id, machine_id, ts AS "timestamp", temperature, strftime(ts, '%Y-%m-%d') AS day FROM fx_readings""",
)
def s8(d):
    """Write the readings under day folders, then read them back."""
    path = new_folder(d.spark, "readings")
    write_readings(d.readings(), path, mode="overwrite")
    stored = read_readings(d.spark, path)
    return stored.select("reading_id", "machine_id", "timestamp", "temperature", F.col("date").alias("day"))


@query(
    "s9_event_json",
    """SELECT '{"type":"alert_new","timestamp":"' || strftime(triggered_at, '%Y-%m-%dT%H:%M:%S.%f') || '","payload":{"alert_id":'
         || CAST(alert_id AS VARCHAR) || ',"machine_id":' || CAST(machine_id AS VARCHAR) || ',"triggered_at":"'
         || strftime(triggered_at, '%Y-%m-%dT%H:%M:%S.%f') || '","severity":"' || severity || '","status":"' || status
         || '","operator_response":' || coalesce('"' || operator_response || '"', 'null') || '}}' AS value FROM fx_alerts""",
)
def s9(d):
    return events.to_event_json(d.alerts(), "alert_new", "triggered_at")


# ---------------------------------------------------------------- row scoping and filters


@query(
    "p1_visible_machines",
    """SELECT machine_id, name, assigned_operator_id, user_name FROM (SELECT m.*, u.name AS user_name FROM fx_machines m
       JOIN fx_users u ON u.user_id = m.assigned_operator_id WHERE u.role = 'operator' AND u.is_active)""",
)
def p1(d):
    scope = access.machines_by_operator(d.machines(), d.users())
    return scope.select("machine_id", "name", "assigned_operator_id", F.col("operator_name").alias("user_name"))


@query("p1_one_operator", "SELECT machine_id, name, status FROM fx_machines WHERE assigned_operator_id = 6")
def p1_operator(d):
    return access.visible_machines(d.machines(), 6, "operator").select("machine_id", "name", "status")


@query("p1_other_role", "SELECT machine_id, name, status FROM fx_machines")
def p1_admin(d):
    return access.visible_machines(d.machines(), 5, "admin").select("machine_id", "name", "status")


@query("p2_alerts_active", "SELECT alert_id, machine_id, severity, status FROM fx_active")
def p2(d):
    return alerts.list_alerts(d.alerts(), d.machines(), status="active").select("alert_id", "machine_id", "severity", "status")


@query(
    "p2_alerts_of_operator",
    """SELECT alert_id, a.machine_id, severity, a.status FROM fx_alerts a JOIN fx_machines m ON a.machine_id = m.machine_id
       WHERE assigned_operator_id = 12 AND severity = 'high'""",
)
def p2_operator(d):
    shown = alerts.list_alerts(d.alerts(), d.machines(), 12, "operator", severity="high")
    return shown.select("alert_id", "machine_id", "severity", "status")


@query(
    "p3_tickets_by_user",
    """SELECT user_id, u.role, ticket_id, status FROM fx_tickets t JOIN fx_users u
         ON (u.role = 'operator' AND u.user_id = t.operator_id) OR (u.role = 'mechanic' AND u.user_id = t.mechanic_id) WHERE is_active""",
)
def p3(d):
    return access.tickets_by_user(d.tickets(), d.users()).select("user_id", "role", "ticket_id", "status")


@query("p3_mechanic_in_progress", "SELECT ticket_id, mechanic_id, status FROM fx_tickets WHERE mechanic_id = 19 AND status = 'in_progress'")
def p3_mechanic(d):
    return access.visible_tickets(d.tickets(), 19, "mechanic", "in_progress").select("ticket_id", "mechanic_id", "status")


@query("p4_found", "SELECT machine_id, name, status FROM fx_machines WHERE machine_id IN (SELECT machine_id FROM fx_schedules)")
def p4_found(d):
    return access.lookup(d.machines(), d.schedules(), "machine_id")[0].select("machine_id", "name", "status")


@query("p4_missing", "SELECT DISTINCT machine_id FROM fx_schedules WHERE machine_id NOT IN (SELECT machine_id FROM fx_machines)")
def p4_missing(d):
    return access.lookup(d.machines(), d.schedules(), "machine_id")[1]


@query(
    "p5_search_users",
    """SELECT user_id, name, email, role FROM fx_users WHERE (lower(name) LIKE '%r#00000000%' OR lower(email) LIKE '%r#00000000%')
         AND role = 'operator'""",
)
def p5(d):
    return admin.search_users(d.users(), "R#00000000", "operator").select("user_id", "name", "email", "role")


@query("p5_search_users_indexed", like="p5_search_users")
def p5_indexed(d):
    """The same search by the trigram index of names and e-mails."""
    path = new_folder(d.spark, "trigrams")
    trigrams.index_texts(d.users(), "user_id", ["name", "email"], path)
    return admin.search_users_indexed(d.users(), path, "R#00000000", "operator").select("user_id", "name", "email", "role")


@query("p6_available_mechanics", "SELECT mechanic_id, skill_type, shift FROM fx_mechanics WHERE login_status = 'available'")
def p6(d):
    return admin.available_mechanics(d.mechanics()).select("mechanic_id", "skill_type", "shift")


@query("p7_open_tickets", "SELECT ticket_id, machine_id, status FROM fx_open_tickets")
def p7(d):
    return tickets.open_tickets(d.tickets()).select("ticket_id", "machine_id", "status")


@query("p8_actionable_alerts", "SELECT alert_id, machine_id, status FROM fx_active")
def p8(d):
    return alerts.actionable(d.alerts()).select("alert_id", "machine_id", "status")


@query(
    "p9_mechanic_worklist",
    """SELECT mechanic_id, ticket_id, kind, rank FROM (
         SELECT *, row_number() OVER (PARTITION BY mechanic_id, kind ORDER BY created_at DESC, ticket_id DESC) AS rank
         FROM (SELECT *, CASE WHEN status IN ('assigned', 'accepted', 'in_progress', 'paused') THEN 'active' ELSE 'completed' END AS kind
               FROM fx_tickets WHERE mechanic_id IS NOT NULL AND status <> 'open') t) r
       WHERE (kind = 'active' AND rank = 1) OR (kind = 'completed' AND rank <= 5)""",
)
def p9(d):
    return tickets.mechanic_worklist(d.tickets()).select("mechanic_id", "ticket_id", "kind", "rank")


@query(
    "p10_next_action",
    """SELECT ticket_id, CASE WHEN status = 'open' OR (status = 'assigned' AND mechanic_id IS NULL) THEN 'assign'
         WHEN status = 'repaired' THEN 'review' WHEN status = 'reviewed' THEN 'close' ELSE 'none' END AS next_action FROM fx_tickets""",
)
def p10(d):
    return tickets.ticket_next_action(d.tickets()).select("ticket_id", "next_action")


@query(
    "p11_reallocation_candidates",
    """SELECT machine_id, risk_level, CASE risk_level WHEN 'low' THEN 'target' ELSE 'source' END AS side FROM fx_risk
       WHERE risk_level IN ('critical', 'high', 'low')""",
)
def p11(d):
    risk = assets.risk_overview(d.machines(), d.tickets())
    return assets.reallocation_candidates(risk).select("machine_id", "risk_level", "side")


@query(
    "p12_recommendations",
    r"""SELECT machine_id, machine_name AS machine, 'Reallocate load from ' || machine_name
         || ' immediately to prevent critical failure within ' || regexp_replace(CAST(rul_hours AS VARCHAR), '\.0$', '') || ' hours.' AS action
       FROM fx_risk WHERE risk_level IN ('critical', 'high')""",
)
def p12(d):
    return assets.recommendations(assets.risk_overview(d.machines(), d.tickets()))


@query("p13_active_users", "SELECT user_id, name, role FROM fx_users WHERE is_active")
def p13(d):
    return access.active_users(d.users()).select("user_id", "name", "role")


# ---------------------------------------------------------------- order and pages


@query("l1_page_offset", "SELECT alert_id, triggered_at, severity FROM fx_alerts ORDER BY triggered_at DESC, alert_id DESC LIMIT 100 OFFSET 200")
def l1(d):
    page = paging.page_offset(d.alerts(), alerts.newest_alerts(), 200, 100)
    return page.select("alert_id", "triggered_at", "severity")


@query(
    "l1_page_after",
    """SELECT alert_id, triggered_at, severity FROM fx_alerts
       WHERE triggered_at < TIMESTAMP '2024-01-15 00:00:00' OR (triggered_at = TIMESTAMP '2024-01-15 00:00:00' AND alert_id < 100)
       ORDER BY triggered_at DESC, alert_id DESC LIMIT 100""",
)
def l1_after(d):
    last = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return paging.page_after_pair(d.alerts(), "triggered_at", "alert_id", last, 100).select("alert_id", "triggered_at", "severity")


@query(
    "l2_paginate",
    """SELECT ticket_id, created_at, status FROM fx_tickets ORDER BY created_at DESC, ticket_id DESC LIMIT 20 OFFSET 40""",
)
def l2(d):
    return paging.paginate(d.tickets().select("ticket_id", "created_at", "status"), tickets.ticket_order(), 3, 20)[0]


@query(
    "l2_deep_page",
    """SELECT ticket_id, created_at, status FROM fx_tickets ORDER BY created_at DESC, ticket_id DESC LIMIT 20
       OFFSET (SELECT (count(*) // 20 - 5) * 20 FROM fx_tickets)""",
)
def l2_deep(d):
    """A page near the end of the list, from the one range that holds it."""
    path = new_folder(d.spark, "pages")
    listed = d.tickets().select("ticket_id", "created_at", "status")
    paging.index_pages(listed, "created_at", "ticket_id", path, rows=1000)
    total = paging.indexed_page(d.spark, path)[1].first()["total"]
    return paging.indexed_page(d.spark, path, total // 20 - 4, 20)[0]


@query(
    "l2_summary",
    """SELECT (SELECT count(*) FROM fx_tickets) AS total, page, size, CASE WHEN size = 0 THEN 0
         ELSE CAST(ceil((SELECT count(*) FROM fx_tickets) / CAST(size AS DOUBLE)) AS BIGINT) END AS pages
       FROM (VALUES (CAST(3 AS BIGINT), CAST(20 AS BIGINT)), (1, 0), (1000000, 20)) AS asked (page, size)""",
)
def l2_summary(d):
    """An inner page, a size of 0, and a page behind the last: the envelope is there all the same."""
    asked = [(3, 20), (1, 0), (1_000_000, 20)]
    rows = [paging.paginate(d.tickets(), tickets.ticket_order(), page, size)[1] for page, size in asked]
    return rows[0].union(rows[1]).union(rows[2])


@query("l3_newest_alerts", "SELECT alert_id, machine_id, triggered_at FROM fx_alerts ORDER BY triggered_at DESC, alert_id DESC LIMIT 5")
def l3_alerts(d):
    return paging.top_n(d.alerts(), alerts.newest_alerts(), 5).select("alert_id", "machine_id", "triggered_at")


@query("l3_newest_audit", "SELECT log_id, action, ts AS \"timestamp\" FROM fx_audit_logs ORDER BY ts DESC, log_id DESC LIMIT 10")
def l3_audit(d):
    return paging.top_n(d.audit_logs(), admin.audit_order(), 10).select("log_id", "action", "timestamp")


@query(
    "l4_risk_order",
    """SELECT machine_id, risk_level, CAST(CASE risk_level WHEN 'critical' THEN 0 WHEN 'high' THEN 1
         WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END AS BIGINT) AS risk_order FROM fx_risk""",
)
def l4(d):
    """Every machine with its place in the order, worst first; sort by it to show."""
    risk = assets.risk_overview(d.machines(), d.tickets()).select("machine_id", "risk_level")
    return risk.withColumn("risk_order", health.risk_order(F.col("risk_level")))


@query(
    "l4_risk_matrix",
    """SELECT machine_id, machine_name AS name, health_score AS health, rul_hours AS rul, CAST(CASE risk_level WHEN 'critical' THEN 4
         WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS BIGINT) AS risk FROM fx_risk""",
)
def l4_matrix(d):
    return assets.risk_matrix(assets.risk_overview(d.machines(), d.tickets()))


# ---------------------------------------------------------------- feed and deletion


@query(
    "u1_notification_feed",
    """SELECT 'alert_new:' || CAST(alert_id AS VARCHAR) AS notification_id, 'alert_new' AS type, 'New Alert' AS title,
         'Machine alert triggered' AS message, '/operator/alerts' AS link, false AS read, CAST(alert_id AS VARCHAR) AS entity_id,
         triggered_at AS "timestamp" FROM fx_alerts
       UNION ALL SELECT 'alert_escalated:' || CAST(alert_id AS VARCHAR), 'alert_escalated', 'Alert Escalated',
         'Alert auto-escalated to Maintenance Manager', '/operator/alerts', false, CAST(alert_id AS VARCHAR), triggered_at
         FROM fx_alerts WHERE status = 'escalated'
       UNION ALL SELECT CASE status WHEN 'closed' THEN 'ticket_closed:' WHEN 'assigned' THEN 'ticket_assigned:' ELSE 'ticket_updated:' END
         || CAST(ticket_id AS VARCHAR), CASE status WHEN 'closed' THEN 'ticket_closed' WHEN 'assigned' THEN 'ticket_assigned'
         ELSE 'ticket_updated' END, 'Ticket Updated', CASE WHEN status IN ('closed', 'assigned') THEN 'Ticket status changed'
         ELSE 'Ticket is ' || status END, '/maintenance/tickets', false, CAST(ticket_id AS VARCHAR), created_at FROM fx_tickets""",
)
def u1(d):
    shown, jobs = d.alerts(), d.tickets().withColumn("text", F.concat(F.lit("Ticket is "), "status"))
    status = F.col("status")
    alert_kinds = [("alert_new", F.lit(True), None), ("alert_escalated", status == "escalated", None)]
    ticket_kinds = [
        ("ticket_assigned", status == "assigned", None), ("ticket_closed", status == "closed", None),
        ("ticket_updated", ~status.isin("assigned", "closed"), "text"),
    ]
    return events.notification_feed(
        events.notices_by_kind(shown, alert_kinds, "triggered_at", "alert_id"),
        events.notices_by_kind(jobs, ticket_kinds, "created_at", "ticket_id"),
    )


GONE = "(SELECT machine_id FROM fx_machines WHERE status = 'offline')"


@query(
    "u2_cascade_delete",
    " UNION ALL ".join(
        f"SELECT '{name}' AS entity, count(*) AS kept, count(DISTINCT machine_id) AS machines FROM {view} WHERE machine_id NOT IN {GONE}"
        for name, view in [
            ("machines", "fx_machines"), ("sensor_readings", "fx_readings"), ("ml_predictions", "fx_predictions"),
            ("alerts", "fx_alerts"), ("tickets", "fx_tickets"), ("cost_logs", "fx_cost_logs"),
        ]
    ),
)
def u2(d):
    tables = {
        "machines": d.machines(), "sensor_readings": d.readings(), "ml_predictions": d.predictions(),
        "alerts": d.alerts(), "tickets": d.tickets(), "cost_logs": d.cost_logs(),
    }
    kept = events.cascade_delete(tables, d.machines().filter(F.col("status") == "offline"))
    parts = [
        table.groupBy("machine_id").agg(F.count("*").alias("_n"))
        .agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("kept"), F.count("*").alias("machines"))
        .select(F.lit(name).alias("entity"), "kept", "machines")
        for name, table in kept.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@query("u2_kept_tickets", f"SELECT ticket_id, machine_id, status FROM fx_tickets WHERE machine_id NOT IN {GONE}")
def u2_tickets(d):
    gone = d.machines().filter(F.col("status") == "offline")
    return events.cascade_delete({"tickets": d.tickets()}, gone)["tickets"].select("ticket_id", "machine_id", "status")
