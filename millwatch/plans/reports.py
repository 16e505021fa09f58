"""Queries of joins, newest rows and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from millwatch.operators import admin, alerts, assets, finance, paging, production, scoring, tickets
from millwatch.plans.registry import query

# ---------------------------------------------------------------- joins


@query(
    "j1_alerts_with_machine",
    """SELECT alert_id, a.machine_id, coalesce(name, 'Unknown') AS machine_name FROM fx_alerts a
       LEFT JOIN fx_machines m ON a.machine_id = m.machine_id""",
)
def j1(d):
    return alerts.alerts_with_machine(d.alerts(), d.machines()).select("alert_id", "machine_id", "machine_name")


@query(
    "j2_enrich_tickets",
    """SELECT ticket_id, t.status, m.name AS machine_name, o.name AS operator_name, k.name AS mechanic_name FROM fx_tickets t
       LEFT JOIN fx_machines m ON t.machine_id = m.machine_id LEFT JOIN fx_users o ON t.operator_id = o.user_id
       LEFT JOIN fx_users k ON t.mechanic_id = k.user_id""",
)
def j2(d):
    full = tickets.enrich_tickets(d.tickets(), d.machines(), d.users())
    return full.select("ticket_id", "status", "machine_name", "operator_name", "mechanic_name")


@query(
    "j3_mechanic_directory",
    "SELECT mechanic_id, skill_type, login_status, name, email FROM fx_mechanics JOIN fx_users ON mechanic_id = user_id",
)
def j3(d):
    return admin.mechanic_directory(d.mechanics(), d.users()).select("mechanic_id", "skill_type", "login_status", "name", "email")


@query(
    "j4_audit_trail",
    """SELECT log_id, a.user_id, coalesce(name, 'System') AS user_name, action, ts AS "timestamp" FROM fx_audit_logs a
       LEFT JOIN fx_users u ON a.user_id = u.user_id""",
)
def j4(d):
    return admin.audit_trail(d.audit_logs(), d.users()).select("log_id", "user_id", "user_name", "action", "timestamp")


@query(
    "j4_audit_page",
    """SELECT log_id, coalesce(name, 'System') AS user_name, ts AS "timestamp" FROM fx_audit_logs a
       LEFT JOIN fx_users u ON a.user_id = u.user_id ORDER BY ts DESC, log_id DESC LIMIT 50""",
)
def j4_page(d):
    """The page is cut before the names are looked up."""
    page = paging.top_n(d.audit_logs(), admin.audit_order(), 50)
    return admin.audit_trail(page, paging.names_of_page(page, d.users(), "user_id")).select("log_id", "user_name", "timestamp")


@query(
    "j5_schedules_with_machine",
    """SELECT schedule_id, s.machine_id, coalesce(name, 'Unknown') AS machine_name, product, s.status FROM fx_schedules s
       LEFT JOIN fx_machines m ON s.machine_id = m.machine_id""",
)
def j5(d):
    named = production.schedules_with_machine(d.schedules(), d.machines())
    return named.select("schedule_id", "machine_id", "machine_name", "product", "status")


@query(
    "j6_machines_needing_alert",
    """SELECT prediction_id, machine_id, risk_level AS severity FROM fx_latest_prediction p WHERE risk_level IN ('high', 'critical', 'medium')
       AND NOT EXISTS (SELECT 1 FROM fx_active a WHERE a.machine_id = p.machine_id)""",
)
def j6(d):
    """Candidates are machines whose newest prediction is medium or worse; any pending or escalated alert holds one back."""
    worse = assets.latest_prediction(d.predictions(), "risk_level").filter(F.col("risk_level").isin("high", "critical", "medium"))
    return scoring.machines_needing_alert(worse, d.alerts()).select("prediction_id", "machine_id", F.col("risk_level").alias("severity"))


@query(
    "j7_machines_without_open_ticket",
    "SELECT machine_id, name FROM fx_machines m WHERE NOT EXISTS (SELECT 1 FROM fx_open_tickets t WHERE t.machine_id = m.machine_id)",
)
def j7(d):
    return tickets.machines_without_open_ticket(d.machines(), d.tickets()).select("machine_id", "name")


@query(
    "j8_open_ticket_count",
    "SELECT machine_id, (SELECT count(*) FROM fx_open_tickets t WHERE t.machine_id = m.machine_id) AS open_tickets FROM fx_machines m",
)
def j8(d):
    return tickets.with_open_ticket_count(d.machines(), d.tickets()).select("machine_id", "open_tickets")


@query(
    "j9_alerts_with_prediction",
    """SELECT alert_id, a.machine_id, triggered_at, prediction_id, health_score, risk_level, failure_type
       FROM fx_alerts a ASOF LEFT JOIN fx_predictions p ON a.machine_id = p.machine_id AND a.triggered_at >= p.ts""",
)
def j9(d):
    return _as_of(d.alerts(), d.predictions())


@query(
    "j9_prediction_before_alert",
    """SELECT alert_id, a.machine_id, triggered_at, prediction_id, health_score, risk_level, failure_type
       FROM (SELECT * REPLACE (triggered_at - INTERVAL 30 MINUTE AS triggered_at) FROM fx_alerts) a
       ASOF LEFT JOIN fx_predictions p ON a.machine_id = p.machine_id AND a.triggered_at >= p.ts""",
)
def j9_before(d):
    """What was known half an hour before each alert."""
    earlier = d.alerts().withColumn("triggered_at", F.expr("triggered_at - INTERVAL 30 MINUTES"))
    return _as_of(earlier, d.predictions())


def _as_of(shown, predictions):
    return alerts.alerts_with_prediction(shown, predictions).select(
        "alert_id", "machine_id", "triggered_at", "prediction.prediction_id", "prediction.health_score",
        "prediction.risk_level", "prediction.failure_type",
    )


@query(
    "j10_machine_detail",
    """SELECT m.machine_id, m.status, r.n AS readings, r.ids AS reading_ids, p.prediction_id, p.risk_level AS predicted_risk,
         coalesce(a.n, 0) AS active_alerts
       FROM fx_machines m
       LEFT JOIN (SELECT machine_id, count(*) AS n, string_agg(CAST(reading_id AS VARCHAR), ',' ORDER BY ts, reading_id) AS ids
                  FROM (SELECT * FROM fx_readings QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY ts DESC, reading_id DESC) <= 24) x
                  GROUP BY machine_id) r ON r.machine_id = m.machine_id
       LEFT JOIN fx_latest_prediction p ON p.machine_id = m.machine_id
       LEFT JOIN (SELECT machine_id, count(*) AS n FROM fx_active GROUP BY machine_id) a ON a.machine_id = m.machine_id""",
)
def j10(d):
    return detail_columns(assets.machine_detail(d.machines(), d.readings(), d.predictions(), d.alerts()))


def detail_columns(detail):
    ids = F.array_join(F.transform("readings", lambda r: r["reading_id"].cast("string")), ",")
    return detail.select(
        "machine_id", "status", F.when(F.col("readings").isNotNull(), F.size("readings")).alias("readings"), ids.alias("reading_ids"),
        "prediction.prediction_id", F.col("prediction.risk_level").alias("predicted_risk"), "active_alerts",
    )


@query("j10_active_alerts", "SELECT alert_id, machine_id, severity FROM fx_active WHERE machine_id IN (SELECT machine_id FROM fx_machines)")
def j10_alerts(d):
    return assets.active_alerts_of(d.machines(), d.alerts()).select("alert_id", "machine_id", "severity")


@query(
    "j11_fleet_snapshot",
    """SELECT m.machine_id, m.name, r.ts AS read_at, r.temperature, r.vibration, p.health_score AS predicted_health_score,
         p.risk_level AS predicted_risk_level, p.rul_hours AS predicted_rul_hours
       FROM fx_machines m LEFT JOIN fx_latest_reading r ON r.machine_id = m.machine_id
       LEFT JOIN fx_latest_prediction p ON p.machine_id = m.machine_id""",
)
def j11(d):
    return snapshot_columns(assets.fleet_snapshot(d.machines(), d.readings(), d.predictions()))


def snapshot_columns(snapshot):
    return snapshot.select(
        "machine_id", "name", "read_at", "temperature", "vibration",
        "predicted_health_score", "predicted_risk_level", "predicted_rul_hours",
    )


@query(
    "j12_task_detail",
    """SELECT ticket_id, t.status, m.name AS machine_name, m.health_score AS machine_health, p.failure_type AS predicted_failure,
         p.rul_hours AS predicted_rul_hours
       FROM fx_tickets t JOIN fx_machines m ON t.machine_id = m.machine_id
       LEFT JOIN fx_latest_prediction p ON p.machine_id = t.machine_id""",
)
def j12(d):
    newest = assets.latest_prediction(d.predictions(), "failure_type", "confidence", "rul_hours")
    detail = tickets.task_detail(d.tickets(), d.machines(), newest)
    return detail.select("ticket_id", "status", "machine_name", "machine_health", "predicted_failure", "predicted_rul_hours")


# ---------------------------------------------------------------- newest rows


@query("w1_recent_readings", "SELECT reading_id, ts AS \"timestamp\", temperature FROM fx_readings WHERE machine_id = 7 ORDER BY ts DESC, reading_id DESC LIMIT 100")
def w1(d):
    return assets.recent_readings(d.readings(), 7).select("reading_id", "timestamp", "temperature")


@query("w2_recent_predictions", "SELECT prediction_id, ts AS \"timestamp\", risk_level FROM fx_predictions WHERE machine_id = 7 ORDER BY ts DESC, prediction_id DESC LIMIT 10")
def w2(d):
    return assets.recent_predictions(d.predictions(), 7).select("prediction_id", "timestamp", "risk_level")


@query(
    "w3_latest_per_machine",
    """SELECT machine_id, reading_id, rank FROM (SELECT r.*, row_number() OVER (PARTITION BY r.machine_id ORDER BY ts DESC, reading_id DESC) AS rank
         FROM fx_readings r JOIN fx_machines m ON r.machine_id = m.machine_id WHERE status <> 'offline') x WHERE rank <= 10""",
)
def w3(d):
    return assets.latest_per_machine(d.readings(), d.machines()).select("machine_id", "reading_id", "rank")


@query(
    "w4_trend_series",
    """SELECT machine_id, row_number() OVER (PARTITION BY machine_id, sensor ORDER BY ts, reading_id) AS point,
         strftime(ts, '%H:%M') AS label, sensor, value
       FROM (SELECT *, 'temperature' AS sensor, temperature AS value FROM fx_readings
             UNION ALL SELECT *, 'vibration', vibration FROM fx_readings UNION ALL SELECT *, 'pressure', pressure FROM fx_readings
             UNION ALL SELECT *, 'current', current_a FROM fx_readings UNION ALL SELECT *, 'rpm', rpm FROM fx_readings
             UNION ALL SELECT *, 'noise_level', noise_level FROM fx_readings) s
       WHERE reading_id IN (SELECT reading_id FROM fx_readings
         QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY ts DESC, reading_id DESC) <= 24)""",
)
def w4(d):
    return assets.trend_series(d.readings())


@query(
    "w5_expense_trend",
    """SELECT CAST(year AS VARCHAR) || '-' || lpad(CAST(month AS VARCHAR), 2, '0') AS period, CAST(sum(amount) AS DOUBLE) AS total_cost,
         count(*) AS ticket_count FROM fx_cost_logs GROUP BY year, month ORDER BY year DESC, month DESC LIMIT 12""",
)
def w5(d):
    return finance.expense_trend(d.cost_logs())


# ---------------------------------------------------------------- aggregates

MONTH = "CAST(year AS VARCHAR) || '-' || lpad(CAST(month AS VARCHAR), 2, '0')"


@query(
    "a1_expenses_month",
    f"SELECT {MONTH} AS period, CAST(sum(amount) AS DOUBLE) AS total_cost, count(*) AS ticket_count FROM fx_cost_logs GROUP BY 1",
)
def a1(d):
    return finance.expenses(d.cost_logs(), "month")


@query(
    "a2_expenses_year",
    "SELECT CAST(year AS VARCHAR) AS period, CAST(sum(amount) AS DOUBLE) AS total_cost, count(*) AS ticket_count FROM fx_cost_logs GROUP BY 1",
)
def a2(d):
    return finance.expenses(d.cost_logs(), "year")


@query(
    "a2_both_grains",
    f"""SELECT 'month' AS grain, {MONTH} AS period, CAST(sum(amount) AS DOUBLE) AS total_cost, count(*) AS ticket_count FROM fx_cost_logs GROUP BY 2
        UNION ALL SELECT 'year', CAST(year AS VARCHAR), CAST(sum(amount) AS DOUBLE), count(*) FROM fx_cost_logs GROUP BY 2""",
)
def a2_grains(d):
    return finance.expenses_all_grains(d.cost_logs())


@query(
    "a3_expense_breakdown",
    f"""SELECT x.period, x.machine_id, coalesce(m.name, 'Unknown') AS machine_name, CAST(x.c AS DOUBLE) AS total_cost, x.n AS ticket_count,
          CAST(sum(x.c) OVER (PARTITION BY x.period) AS DOUBLE) AS period_cost,
          CAST(sum(x.n) OVER (PARTITION BY x.period) AS BIGINT) AS period_tickets
        FROM (SELECT {MONTH} AS period, machine_id, sum(amount) AS c, count(*) AS n FROM fx_cost_logs GROUP BY 1, 2) x
        LEFT JOIN fx_machines m ON m.machine_id = x.machine_id""",
)
def a3(d):
    return finance.expense_breakdown(d.cost_logs(), d.machines())


@query(
    "a4_factory_stats",
    """SELECT (SELECT count(*) FROM fx_machines) AS total_machines, (SELECT count(*) FROM fx_machines WHERE status = 'normal') AS machines_operational,
         (SELECT count(*) FROM fx_machines WHERE status = 'warning') AS machines_warning,
         (SELECT count(*) FROM fx_machines WHERE status = 'critical') AS machines_critical,
         (SELECT floor(CAST(sum(CAST(health_score AS DECIMAL(18,6))) AS DOUBLE) / count(*) * 10 + 0.5) / 10 FROM fx_machines) AS avg_health_score,
         (SELECT CASE WHEN avg(health_score) > 50 THEN 94.7E0 ELSE 78.2E0 END FROM fx_machines) AS overall_uptime_percent,
         (SELECT count(*) FROM fx_alerts) AS total_alerts, (SELECT count(*) FROM fx_open_tickets) AS open_tickets,
         (SELECT CAST(sum(amount) AS DOUBLE) FROM fx_cost_logs) AS total_cost,
         (SELECT CAST(sum(amount) AS DOUBLE) FROM fx_cost_logs WHERE year = 2001) AS cost_ytd""",
)
def a4(d):
    return finance.factory_stats(d.machines(), d.alerts(), d.tickets(), d.cost_logs(), "2001-12-01")


BILLED = """(SELECT DISTINCT {period} AS period, c.ticket_id, t.time_taken_hours FROM fx_cost_logs c JOIN fx_tickets t
   ON c.ticket_id = t.ticket_id WHERE t.time_taken_hours IS NOT NULL)"""


@query(
    "a5_avg_repair_time",
    f"""SELECT period, count(*) AS repaired_tickets, CAST(sum(time_taken_hours) AS DOUBLE) / count(*) AS avg_repair_time
        FROM {BILLED.format(period=MONTH)} b GROUP BY period""",
)
def a5(d):
    return finance.avg_repair_time(d.tickets(), d.cost_logs())


@query(
    "a5_avg_repair_time_year",
    f"""SELECT period, count(*) AS repaired_tickets, CAST(sum(time_taken_hours) AS DOUBLE) / count(*) AS avg_repair_time
        FROM {BILLED.format(period='CAST(year AS VARCHAR)')} b GROUP BY period""",
)
def a5_year(d):
    return finance.avg_repair_time(d.tickets(), d.cost_logs(), "year")


@query("a6_production_impact", "SELECT * FROM fx_impact")
def a6(d):
    return assets.production_impact(d.machines())


@query(
    "a7_production_kpis",
    """SELECT CAST(sum(CAST(downtime_hours AS DECIMAL(18,1))) AS DOUBLE) AS expected_downtime_hours,
         count(*) FILTER (WHERE risk_level IN ('high', 'critical')) AS at_risk_machines FROM fx_impact""",
)
def a7(d):
    return assets.production_kpis(d.machines())


@query("a8_risk_overview", "SELECT * FROM fx_risk")
def a8(d):
    return assets.by_risk(assets.risk_overview(d.machines(), d.tickets()))


CLOSE_HOURS = "CAST(sum(epoch_us(closed_at) - epoch_us(created_at)) AS DOUBLE) / 3600000000.0E0"


@query(
    "a9_mttr",
    f"""SELECT count(*) AS repaired_tickets, CAST(sum(time_taken_hours) AS DOUBLE) / count(*) AS mttr_hours,
         {CLOSE_HOURS} / count(closed_at) AS mean_hours_to_close FROM fx_tickets WHERE time_taken_hours IS NOT NULL""",
)
def a9(d):
    return tickets.mttr(d.tickets())


@query(
    "a9_mttr_by_machine",
    f"""SELECT machine_id, count(*) AS repaired_tickets, CAST(sum(time_taken_hours) AS DOUBLE) / count(*) AS mttr_hours,
         CASE WHEN count(closed_at) > 0 THEN {CLOSE_HOURS} / count(closed_at) END AS mean_hours_to_close
       FROM fx_tickets WHERE time_taken_hours IS NOT NULL GROUP BY machine_id""",
)
def a9_machine(d):
    return tickets.mttr(d.tickets(), "machine_id")


GAPS = """(SELECT machine_id, epoch_us(triggered_at) - epoch_us(lag(triggered_at) OVER (PARTITION BY machine_id ORDER BY triggered_at, alert_id)) AS gap
  FROM fx_alerts WHERE severity = 'critical')"""


@query(
    "a10_mtbf_by_machine",
    f"""SELECT machine_id, count(*) AS failures,
          CASE WHEN count(gap) > 0 THEN CAST(sum(gap) AS BIGINT) / 3600000000.0E0 / count(gap) END AS mtbf_hours
        FROM {GAPS} g GROUP BY machine_id""",
)
def a10(d):
    return alerts.mtbf(d.alerts())


@query(
    "a10_fleet_mtbf",
    f"SELECT count(gap) AS gaps, CASE WHEN count(gap) > 0 THEN CAST(sum(gap) AS BIGINT) / 3600000000.0E0 / count(gap) END AS mtbf_hours FROM {GAPS} g",
)
def a10_fleet(d):
    return alerts.fleet_mtbf(d.alerts())


@query("a11_uptime_rule", "SELECT CASE WHEN avg(health_score) > 50 THEN 94.7E0 ELSE 78.2E0 END AS overall_uptime_percent FROM fx_machines")
def a11(d):
    return assets.uptime_rule(d.machines())


@query(
    "a12_operator_kpis",
    """SELECT u.user_id AS operator_id, count(m.machine_id) AS machines, count(*) FILTER (WHERE m.status = 'critical') AS critical_machines,
         CAST(coalesce(sum(n), 0) AS BIGINT) AS active_alerts,
         CASE WHEN count(m.machine_id) = 0 THEN 0.0E0 ELSE
           CAST(sum(CAST(coalesce(health_score, 0) AS DECIMAL(18,6))) FILTER (WHERE m.machine_id IS NOT NULL) AS DOUBLE) / count(m.machine_id) END AS average_health
       FROM fx_users u LEFT JOIN fx_machines m ON m.assigned_operator_id = u.user_id
       LEFT JOIN (SELECT machine_id, count(*) AS n FROM fx_active GROUP BY machine_id) a ON a.machine_id = m.machine_id
       WHERE u.role = 'operator' AND u.is_active GROUP BY u.user_id""",
)
def a12(d):
    return assets.operator_kpis(d.machines(), d.alerts(), d.users())


@query(
    "a13_maintenance_kpis",
    """SELECT count(*) FILTER (WHERE status = 'open') AS open_tickets, count(*) FILTER (WHERE status IN ('assigned', 'in_progress')) AS in_progress,
         count(*) FILTER (WHERE status = 'repaired') AS to_review,
         (SELECT count(*) FROM fx_mechanics WHERE login_status = 'available') AS available_mechanics,
         (SELECT count(*) FROM fx_mechanics) AS total_mechanics FROM fx_tickets""",
)
def a13(d):
    return tickets.maintenance_kpis(d.tickets(), d.mechanics())


@query(
    "a14_owner_kpis",
    f"""WITH months AS (SELECT year, month, {MONTH} AS period, sum(amount) AS c FROM fx_cost_logs GROUP BY 1, 2, 3),
        last AS (SELECT * FROM months ORDER BY year DESC, month DESC LIMIT 1),
        y AS (SELECT CAST(sum(c) AS DOUBLE) AS c FROM months WHERE year = (SELECT year FROM last)),
        h AS (SELECT floor(CAST(sum(CAST(health_score AS DECIMAL(18,6))) AS DOUBLE) / count(*) * 10 + 0.5) / 10 AS h FROM fx_machines)
        SELECT last.period AS current_period, CAST(last.c AS DOUBLE) AS current_month_cost, y.c AS current_year_cost,
          y.c * 0.45E0 AS estimated_savings, floor(y.c * 0.45E0 / (CASE WHEN y.c = 0 THEN 1E0 ELSE y.c END) * 100E0 * 10E0 + 0.5E0) / 10E0 AS roi_percent,
          floor(h.h * 0.95E0 * 10E0 + 0.5E0) / 10E0 AS efficiency_score,
          100E0 - floor(h.h * 0.95E0 * 10E0 + 0.5E0) / 10E0 AS improvement_opportunity FROM last, y, h""",
)
def a14(d):
    return finance.owner_kpis(d.cost_logs(), d.machines())


@query(
    "a15_critical_banner",
    """WITH top AS (SELECT a.*, coalesce(m.name, 'Unknown') AS machine_name FROM fx_alerts a LEFT JOIN fx_machines m ON m.machine_id = a.machine_id
         WHERE severity = 'critical' ORDER BY triggered_at DESC, alert_id DESC LIMIT 2)
       SELECT string_agg(machine_name || ' ' || CAST(alert_id AS VARCHAR), ', ' ORDER BY triggered_at DESC, alert_id DESC) AS newest,
         (SELECT count(*) FROM fx_alerts WHERE severity = 'critical') AS critical_alerts,
         greatest((SELECT count(*) FROM fx_alerts WHERE severity = 'critical') - 2, 0) AS more FROM top""",
)
def a15(d):
    banner = alerts.critical_banner(d.alerts(), d.machines())
    shown = F.transform("newest", lambda a: F.concat(a["machine_name"], F.lit(" "), a["alert_id"].cast("string")))
    return banner.select(F.array_join(shown, ", ").alias("newest"), "critical_alerts", "more")


@query("a16_user_kpis", "SELECT count(*) AS total_users, count(*) FILTER (WHERE is_active) AS active_users FROM fx_users")
def a16(d):
    return admin.user_kpis(d.users())


@query("a17_unread_counts", "SELECT user_id, count(*) FILTER (WHERE NOT read) AS unread FROM fx_notifications GROUP BY user_id")
def a17(d):
    return admin.unread_counts(d.notifications())
