"""Small cases with known results."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from millwatch import schemas
from millwatch.functions import gauges, health, texts
from millwatch.functions.sql import register_functions
from millwatch.operators import access, admin, alerts, assets, finance, paging, production, scoring, tickets

FLEET = [
    ("M1", "CNC Mill #1", "Plant A", 87.5, "low", 1240.0, "normal"),
    ("M2", "Conveyor Belt #3", "Plant A", 63.2, "medium", 480.0, "warning"),
    ("M3", "Air Compressor #2", "Plant B", 41.0, "high", 90.0, "critical"),
    ("M4", "Hydraulic Press #5", "Plant B", 95.1, "low", 2100.0, "normal"),
    ("M5", "Turbine Generator #1", "Power House", 22.8, "critical", 12.0, "critical"),
]


@pytest.fixture(scope="module")
def fleet(spark):
    return spark.createDataFrame(FLEET, "machine_id string, name string, location string, health_score double, risk_level string, rul_hours double, status string")


@pytest.fixture(scope="module")
def shop(spark):
    rows = [
        ("T1", "M2", "open", None, None, "2024-01-10 10:00:00", None),
        ("T2", "M3", "assigned", "K3", None, "2024-01-10 09:00:00", None),
        ("T3", "M5", "in_progress", "K3", None, "2024-01-10 07:00:00", None),
        ("T4", "M4", "closed", "K3", 2.5, "2024-01-05 12:00:00", "2024-01-06 12:00:00"),
    ]
    return spark.createDataFrame(
        rows, "ticket_id string, machine_id string, status string, mechanic_id string, time_taken_hours double, created_at string, closed_at string"
    ).withColumns({c: F.col(c).cast("timestamp") for c in ("created_at", "closed_at")})


@pytest.mark.parametrize("t, v, score, risk", [(45.0, 2.0, 100.0, "low"), (80.0, 6.0, 7.5, "critical"), (90.5, 0.1, 31.75, "high"), (200.0, 50.0, 0.0, "critical")])
def test_health_score(spark, t, v, score, risk):
    row = spark.range(1).select(health.health_score(F.lit(t), F.lit(v)).alias("h")).withColumn("r", health.risk_level(F.col("h"))).first()
    assert (row.h, row.r) == (score, risk)


@pytest.mark.parametrize("score, risk", [(29.99, "critical"), (30.0, "high"), (59.99, "high"), (60.0, "medium"), (79.99, "medium"), (80.0, "low"), (None, None)])
def test_risk_edges(spark, score, risk):
    assert spark.range(1).select(health.risk_level(F.lit(score).cast("double")).alias("r")).first().r == risk


def test_sql_functions_equal_column_functions(spark):
    names = register_functions(spark)
    assert len(names) == len(set(names))
    grid = spark.range(0, 4000).selectExpr("CAST(id AS STRING) AS k", "20 + (id % 80) * 1.3D AS t", "(id % 37) * 0.4D AS v")
    by_sql = grid.selectExpr("*", "health_score(t, v) AS h").selectExpr("*", "risk_level(h) AS r").selectExpr(
        "k", "h", "r", "rul_hours(r, k) AS rul", "prediction_confidence(r, k) AS c", "failure_type(r, v) AS f", "machine_status(r) AS s",
        "alert_severity(r) AS sev", "sensor_band(t, 70D, 90D) AS band", "gauge_percent(t, 90D) AS fill", "health_band(h) AS hb",
        "loss_band(100D - h) AS lb", "risk_order(r) AS ro", "label_text('in_progress_now') AS lab", "month_period(2024, 3) AS p",
        "breach_type(t, 85D) AS b",
    )
    h, r, t, v, k = F.col("h"), F.col("r"), F.col("t"), F.col("v"), F.col("k")
    by_column = grid.withColumn("h", health.health_score(t, v)).withColumn("r", health.risk_level(h)).select(
        "k", "h", "r", health.rul_hours(r, k).alias("rul"), health.confidence(r, k).alias("c"), health.failure_type(r, v).alias("f"),
        health.machine_status(r).alias("s"), health.severity(r).alias("sev"), gauges.sensor_band(t, F.lit(70.0), F.lit(90.0)).alias("band"),
        gauges.gauge_percent(t, F.lit(90.0)).alias("fill"), gauges.health_band(h).alias("hb"), gauges.loss_band(100.0 - h).alias("lb"),
        health.risk_order(r).alias("ro"), texts.label(F.lit("in_progress_now")).alias("lab"),
        texts.month_period(F.lit(2024), F.lit(3)).alias("p"), gauges.breach_type(t).alias("b"),
    )
    assert sorted(by_sql.collect()) == sorted(by_column.collect())
    assert by_sql.first().lab == "IN PROGRESS_NOW"


def test_hot_reading_alarm(spark, fleet):
    readings = spark.createDataFrame([("R1", "M1", 90.5, 0.1), ("R2", "M1", 85.0, 0.65), ("R3", "M9", 99.0, 9.0)], "reading_id string, machine_id string, temperature double, vibration double")
    readings = readings.withColumn("timestamp", F.lit("2024-01-10 10:00:00").cast("timestamp"))
    alarm = alerts.threshold_alerts(readings, fleet).collect()
    assert [(a.type, a.severity, a.status) for a in alarm] == [("CRITICAL_TEMP", "critical", "pending")]
    assert alarm[0].message == "Critical threshold breached on CNC Mill #1. Temp: 90.5, Vibe: 0.1"
    scored = scoring.score_readings(readings.filter("reading_id = 'R1'")).first()
    assert (scored.health_score, scored.risk_level) == (31.8, "high")


def test_impact_and_kpis(fleet):
    impact = {r.machine_id: (r.downtime_hours, r.production_loss_percent) for r in assets.production_impact(fleet).collect()}
    assert impact == {"M1": (5.0, 2.5), "M2": (14.7, 7.4), "M3": (23.6, 11.8), "M4": (2.0, 1.0), "M5": (30.9, 15.4)}
    kpis = assets.production_kpis(fleet).first()
    assert (kpis.expected_downtime_hours, kpis.at_risk_machines) == (76.2, 2)


def test_risk_overview_order(fleet, shop):
    rows = assets.by_risk(assets.risk_overview(fleet, shop)).collect()
    assert [(r.machine_id, r.open_tickets) for r in rows] == [("M5", 1), ("M3", 1), ("M2", 1), ("M1", 0), ("M4", 0)]
    advice = assets.recommendations(assets.risk_overview(fleet, shop)).filter("machine_id = 'M5'").first().action
    assert advice == "Reallocate load from Turbine Generator #1 immediately to prevent critical failure within 12 hours."
    sides = {r.machine_id: r.side for r in assets.reallocation_candidates(assets.risk_overview(fleet, shop)).collect()}
    assert sides == {"M5": "source", "M3": "source", "M1": "target", "M4": "target"}


def test_ticket_figures(shop, spark):
    assert tickets.mttr(shop).first().asDict() == {"repaired_tickets": 1, "mttr_hours": 2.5, "mean_hours_to_close": 24.0}
    assert tickets.open_tickets(shop).count() == 3
    work = {(r.kind, r.ticket_id) for r in tickets.mechanic_worklist(shop).collect()}
    assert work == {("active", "T2"), ("completed", "T4")}
    acts = {r.ticket_id: r.next_action for r in tickets.ticket_next_action(shop).collect()}
    assert acts == {"T1": "assign", "T2": "none", "T3": "none", "T4": "none"}


EXPENSES = {
    "2024-08": 24600, "2024-09": 37500, "2024-10": 19800, "2024-11": 41700, "2024-12": 29300, "2025-01": 35600,
    "2025-02": 22100, "2025-03": 52400, "2025-04": 18900, "2025-05": 31800, "2025-06": 45200, "2025-07": 28500,
}
REPAIR = {
    "2024-08": (4, 2.4), "2024-09": (5, 3.1), "2024-10": (3, 2.1), "2024-11": (6, 3.4), "2024-12": (4, 2.6), "2025-01": (5, 3.0),
    "2025-02": (4, 2.3), "2025-03": (7, 3.8), "2025-04": (3, 2.0), "2025-05": (5, 2.5), "2025-06": (6, 3.2), "2025-07": (4, 2.8),
}


def test_expenses(spark, fleet):
    rows = [(f"C{i}", "M1", Decimal(cost), int(p[5:]), int(p[:4])) for i, (p, cost) in enumerate(EXPENSES.items())]
    cost = spark.createDataFrame(rows, "cost_id string, machine_id string, amount decimal(18,2), month int, year int")
    monthly = {r.period: float(r.total_cost) for r in finance.expenses(cost).collect()}
    assert monthly == {p: float(c) for p, c in EXPENSES.items()}
    yearly = {r.period: float(r.total_cost) for r in finance.expenses(cost, "year").collect()}
    assert yearly == {"2024": 152900.0, "2025": 234500.0}
    assert [r.period for r in finance.expense_trend(cost, 3).collect()] == ["2025-05", "2025-06", "2025-07"]
    owner = finance.owner_kpis(cost, fleet).first()
    assert (owner.current_period, owner.current_month_cost, owner.current_year_cost, owner.roi_percent) == ("2025-07", 28500.0, 234500.0, 45.0)
    parts = spark.createDataFrame([(p, n, h) for p, (n, h) in REPAIR.items()], "period string, repaired_tickets bigint, avg_repair_time double")
    merged = {r.period: r.avg_repair_time for r in finance.merge_repair_times(parts).collect()}
    assert merged["2024"] == pytest.approx((4 * 2.4 + 5 * 3.1 + 3 * 2.1 + 6 * 3.4 + 4 * 2.6) / 22)


def test_owner_kpis_without_cost(spark, fleet):
    none = spark.createDataFrame([], "machine_id string, amount decimal(18,2), month int, year int")
    owner = finance.owner_kpis(none, fleet).first()
    assert (owner.current_period, owner.current_year_cost, owner.roi_percent) == (None, 0.0, 0.0)


def test_escalation_ticks(spark):
    rows = [(1, "pending", "2024-01-01 10:00:00"), (2, "pending", "2024-01-01 10:00:01"), (3, "pending", "2024-01-01 10:01:00"), (4, "resolved", "2024-01-01 09:00:00")]
    given = spark.createDataFrame(rows, "alert_id int, status string, triggered_at string").withColumn("triggered_at", F.col("triggered_at").cast("timestamp"))
    after = {r.alert_id: (r.status, r.auto_escalated, r.escalated_at and r.escalated_at.strftime("%H:%M:%S")) for r in alerts.escalate(given, "2024-01-01 10:06:00").collect()}
    assert after == {
        1: ("escalated", True, "10:05:00"), 2: ("escalated", True, "10:06:00"), 3: ("escalated", True, "10:06:00"), 4: ("resolved", False, None),
    }
    again = alerts.escalate(given, "2024-01-01 10:05:59").filter("status = 'escalated'").collect()
    assert [r.alert_id for r in again] == [1]


def test_mtbf_is_the_mean_gap(spark):
    rows = [("M1", f"2024-01-01 {h:02d}:00:00", "critical") for h in (1, 3, 9)] + [("M2", "2024-01-01 01:00:00", "critical"), ("M3", "2024-01-01 01:00:00", "low")]
    given = spark.createDataFrame(rows, "machine_id string, triggered_at string, severity string").withColumn("triggered_at", F.col("triggered_at").cast("timestamp"))
    assert {r.machine_id: r.mtbf_hours for r in alerts.mtbf(given).collect()} == {"M1": 4.0, "M2": None}
    assert alerts.fleet_mtbf(given).first().asDict() == {"gaps": 2, "mtbf_hours": 4.0}


def test_gauges(spark):
    limits = schemas.GAUGE_LIMITS
    row = spark.range(1).select(
        gauges.sensor_band(F.lit(70.0), F.lit(limits["temperature"][0]), F.lit(limits["temperature"][1])).alias("w"),
        gauges.sensor_band(F.lit(90.0), F.lit(70.0), F.lit(90.0)).alias("c"), gauges.sensor_band(F.lit(69.9), F.lit(70.0), F.lit(90.0)).alias("n"),
        gauges.gauge_percent(F.lit(54.0), F.lit(90.0)).alias("half"), gauges.gauge_percent(F.lit(500.0), F.lit(90.0)).alias("full"),
        gauges.gauge_percent(F.lit(-5.0), F.lit(90.0)).alias("empty"), gauges.loss_bar_width(F.lit(30.0)).alias("bar"),
    ).first()
    assert tuple(row) == ("warning", "critical", "normal", 50.0, 100.0, 0.0, 100.0)


def test_reallocate_one_machine(spark, fleet, shop):
    lines = spark.createDataFrame([("S1", "M5", "halted", "Critical failure"), ("S2", "M1", "on_track", None)], "schedule_id string, machine_id string, status string, delay_reason string")
    moves = spark.createDataFrame([("V1", 1, "M5", "M4", "U4"), ("V2", 2, "M1", "M4", "U4"), ("V3", 3, "M1", "M8", "U4")], "move_id string, seq int, source string, target string, user_id string")
    moves = moves.withColumn("moved_at", F.lit("2024-01-10 12:00:00").cast("timestamp"))
    out = production.reallocate(fleet, lines, shop, moves)
    assert {r.machine_id: r.status for r in out["machines"].collect()}["M5"] == "maintenance"
    assert {tuple(r) for r in out["schedules"].collect()} == {
        ("S1", "M4", "on_track", "Reallocated from Turbine Generator #1"), ("S2", "M4", "on_track", "Reallocated from CNC Mill #1"),
    }
    assert [(r.machine_id, r.description) for r in out["tickets"].collect()] == [
        ("M1", "Auto-generated: Machine load reallocated to Hydraulic Press #5. Maintenance required.")
    ]
    assert out["audit_rows"].count() == out["notifications"].count() == 2
    assert [(r.move_id, r.reason) for r in out["rejected"].collect()] == [("V3", "Machine not found")]


def test_pages(spark):
    rows = spark.range(45).withColumnRenamed("id", "n")
    page, summary = paging.paginate(rows, [F.col("n").desc()], 3, 20)
    assert [r.n for r in page.collect()] == [4, 3, 2, 1, 0]
    assert tuple(summary.first()) == (45, 3, 20, 3)
    for number, size, pages in ((1, 0, 0), (1_000_000, 20, 3)):
        page, summary = paging.paginate(rows, [F.col("n")], number, size)
        assert page.count() == 0 and tuple(summary.first()) == (45, number, size, pages)
    assert [r.n for r in paging.page_after(rows, "n", 41, 2).collect()] == [42, 43]
    assert [r.n for r in paging.page_after(rows, "n", 2, 5, descending=True).collect()] == [1, 0]
    assert paging.page_number(100, 50) == 3


def test_scoping_and_search(spark):
    people = spark.createDataFrame([("U1", "Alex Morgan", "alex@example.com", "operator", True), ("U2", "Sarah Chen", "sarah@example.com", "admin", False)], "user_id string, name string, email string, role string, is_active boolean")
    machines = spark.createDataFrame([("M1", "U1"), ("M2", None), ("M3", "U2")], "machine_id string, assigned_operator_id string")
    assert [r.machine_id for r in access.visible_machines(machines, "U1", "operator").collect()] == ["M1"]
    assert access.visible_machines(machines, "U2", "admin").count() == 3
    assert [r.machine_id for r in access.machines_by_operator(machines, people).collect()] == ["M1"]
    assert [r.user_id for r in admin.search_users(people, "MORGAN").collect()] == ["U1"]
    assert admin.search_users(people, "example", "all").count() == 2
    assert admin.user_kpis(people).first().asDict() == {"total_users": 2, "active_users": 1}


def test_mechanic_assignment_can_be_cleared_or_left(spark):
    staff = spark.createDataFrame([("K1", "busy", "T1"), ("K2", "busy", "T2")], "mechanic_id string, login_status string, current_assignment_id string")
    stated = spark.createDataFrame([("K1", 1, "available", None, ["login_status", "current_assignment_id"]), ("K2", 1, "offline", None, ["login_status"])], "mechanic_id string, seq int, login_status string, current_assignment_id string, _set array<string>")
    assert {tuple(r) for r in admin.update_mechanics(staff, stated).collect()} == {("K1", "available", None), ("K2", "offline", "T2")}
    assert {tuple(r) for r in admin.update_mechanics(staff, stated.drop("_set")).collect()} == {("K1", "available", "T1"), ("K2", "offline", "T2")}


def test_life_cycle_to_closed(spark):
    ticket = spark.createDataFrame([("T1", "M1", "open", None, None)], "ticket_id string, machine_id string, status string, mechanic_id string, manager_id string")
    ticket = ticket.withColumns({"repair_report": F.lit(None).cast("string"), "parts_used": F.lit(None).cast("string"), "time_taken_hours": F.lit(None).cast("double"), "repair_cost": F.lit(None).cast("decimal(18,2)"), "closed_at": F.lit(None).cast("timestamp")})
    staff = spark.createDataFrame([("K1", "available", None), ("K2", "available", None)], "mechanic_id string, login_status string, current_assignment_id string")
    words = ["assign", "reject", "assign", "accept", "start", "pause", "resume", "report", "review", "close"]
    rows = [("T1", i, w, "K1" if i < 2 else "K2", "G1", "done", "belt", 2.5, Decimal("1850.00"), f"2024-01-10 {10 + i}:00:00") for i, w in enumerate(words)]
    actions = spark.createDataFrame(rows, "ticket_id string, seq int, action string, mechanic_id string, manager_id string, repair_report string, parts_used string, time_taken_hours double, repair_cost decimal(18,2), changed_at string")
    actions = actions.withColumns({"changed_at": F.col("changed_at").cast("timestamp"), "changed_by": F.lit("G1")})
    out = tickets.ticket_transitions(ticket, staff, actions)
    end = out["tickets"].first()
    assert (end.status, end.mechanic_id, end.repair_report, end.time_taken_hours, float(end.repair_cost), str(end.closed_at)) == ("closed", "K2", "done", 2.5, 1850.0, "2024-01-10 19:00:00")
    assert {tuple(r) for r in out["mechanics"].collect()} == {("K1", "available", None), ("K2", "available", None)}
    assert [(r.ticket_id, r.machine_id, float(r.amount), r.month, r.year) for r in out["cost_rows"].collect()] == [("T1", "M1", 1850.0, 1, 2024)]
    assert out["audit_rows"].count() == 10
    halfway = tickets.ticket_transitions(ticket, staff, actions.filter("seq <= 1"))
    assert halfway["tickets"].first().status == "open" and halfway["tickets"].first().mechanic_id is None
