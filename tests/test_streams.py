"""Streams from files: order, late and repeated input, restarts, and equality with batch."""

import json
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from millwatch.operators import alerts, events, finance, scoring
from millwatch.sources.feed import event_time, read_sensor_stream
from millwatch.streaming import alarms, closing, ingest, newest, runs, seen, spending, state

START = datetime(2024, 1, 1, 10, 0, 0)
SENSOR = {"pressure": 4.0, "current": 12.0, "rpm": 1800.0, "noise_level": 60.0}


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("\n".join(json.dumps(r) for r in rows))


def at(seconds):
    return (START + timedelta(seconds=seconds)).isoformat()


def reading(i, machine, seconds, t=60.0, v=0.5):
    return {"reading_id": f"R{i}", "machine_id": machine, "timestamp": at(seconds), "temperature": t, "vibration": v, **SENSOR}


@pytest.fixture
def machines(spark):
    return spark.createDataFrame([("M1", "Mill"), ("M2", "Belt")], "machine_id string, name string")


def finish(spark, stream, tmp_path):
    runs.to_files(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()


def test_alarms_across_restarts(spark, tmp_path, machines):
    feed = tmp_path / "in"
    put(feed, "a", [reading(1, "M1", 0, t=90.5), reading(2, "M2", 1), reading(3, "M9", 2, t=99.0)])
    stream = lambda: alerts.threshold_alerts(read_sensor_stream(spark, str(feed)), machines).select("alert_id", "machine_id", "type")
    assert [(r.machine_id, r.type) for r in finish(spark, stream(), tmp_path)] == [("M1", "CRITICAL_TEMP")]
    put(feed, "b", [reading(4, "M2", 30, v=0.7)])
    assert sorted((r.machine_id, r.type) for r in finish(spark, stream(), tmp_path)) == [("M1", "CRITICAL_TEMP"), ("M2", "CRITICAL_VIBE")]


def test_scores_of_closed_windows(spark, tmp_path):
    feed = tmp_path / "in"
    rows = [reading(1, "M1", 5, t=80.0, v=6.0), reading(2, "M1", 50, t=45.0), reading(3, "M2", 70, t=90.5, v=0.1), reading(4, "M1", 2000)]
    put(feed, "a", rows)
    got = {r.prediction_id: r for r in finish(spark, alarms.stream_scores(read_sensor_stream(spark, str(feed))), tmp_path)}
    batch = scoring.score_readings(spark.read.schema(read_sensor_stream(spark, str(feed)).schema).json(str(feed)))
    want = {r.prediction_id: r for r in batch.collect()}
    assert set(got) == {"R2", "R3"}
    for key, row in got.items():
        assert row.asDict() == want[key].asDict()


@pytest.mark.parametrize("kind, name", [("bigint", int), ("string", "A{}".format)])
def test_escalations(spark, tmp_path, kind, name):
    feed, out = tmp_path / "in", str(tmp_path / "out")
    opened = lambda a, s: {"alert_id": name(a), "machine_id": name(1), "kind": "opened", "event_time": at(s)}
    answered = lambda a, s: {"alert_id": name(a), "machine_id": name(1), "kind": "answered", "event_time": at(s)}
    line = f"alert_id {kind}, machine_id {kind}, kind string, event_time timestamp"

    def run():
        stream = event_time(spark.readStream.schema(line).json(str(feed)), "event_time")
        alarms.escalate_stream(stream, out, str(tmp_path / "cp")).awaitTermination()
        return {r.alert_id: (r.triggered_at, r.escalated_at) for r in closing.results(spark, out, "escalated").collect()}

    put(feed, "a", [opened(1, 0), opened(2, 1), answered(2, 200), answered(3, 10), opened(4, 100), opened(5, 110)])
    assert run() == {}
    put(feed, "b", [opened(3, 5), answered(4, 421), answered(5, 420), opened(1, 20), opened(6, 5000)])
    want = {1: (0, 300), 4: (100, 420)}
    assert run() == {name(a): (START + timedelta(seconds=t), START + timedelta(seconds=e)) for a, (t, e) in want.items()}
    put(feed, "c", [answered(4, 400), opened(7, 4200), answered(6, 5100), answered(8, 6000) | {"alert_id": None}])
    assert run().keys() == {name(1), name(4), name(7)}
    late = closing.late_rows(spark, out).collect()
    assert [(r.alert_id, r.kind, r.event_time, r.mark) for r in late] == [(name(4), "answered", START + timedelta(seconds=400), START + timedelta(seconds=4400))]
    put(feed, "d", [answered(9, 9000)])
    assert run().keys() == {name(1), name(4), name(7)}


@pytest.mark.parametrize("kind, name", [("bigint", int), ("string", "M{}".format)])
def test_dedupe_stream_equals_batch_in_any_arrival_order(spark, tmp_path, kind, name):
    import random

    rng = random.Random(8)
    rows = []
    for i in range(400):
        machine = name(0 if rng.random() < 0.34 else rng.randrange(1, 6))
        side = 0 if rng.random() < 0.3 else 1
        rows.append({"machine_id": machine, "side": side, "alert_id": f"A{i:04d}" if side else None, "severity": "high" if side else None, "event_time": at(i * 20 + rng.random())})
    rows += [r | {"alert_id": "A9" + r["alert_id"]} for r in rows[:40] if r["side"]]  # two candidates of one instant
    rows += [r | {"side": 0} for r in rows[40:60] if r["side"]]  # an answer and a candidate of one instant
    rows.sort(key=lambda r: r["event_time"])
    feed, out = tmp_path / "in", str(tmp_path / "out")
    schema = f"machine_id {kind}, side int, alert_id string, severity string, event_time timestamp"

    def run():
        stream = event_time(spark.readStream.schema(schema).json(str(feed)), "event_time")
        alarms.dedupe_stream(stream, out, str(tmp_path / "cp")).awaitTermination()

    for part in range(4):
        some = rows[part * 120 : part * 120 + 120]
        rng.shuffle(some)
        put(feed, f"p{part}", some)
        run()
    put(feed, "end", [{"machine_id": name(99), "side": 0, "alert_id": None, "severity": None, "event_time": at(400 * 20 + 3600)}])
    run()
    got = {r.alert_id for r in closing.results(spark, out, "opened").collect()}
    given = spark.createDataFrame([(r["machine_id"], r["side"], r["alert_id"], r["severity"], datetime.fromisoformat(r["event_time"])) for r in rows], schema)
    candidates = given.filter("side = 1").select("alert_id", "machine_id", F.col("event_time").alias("triggered_at"), "severity")
    answers = given.filter("side = 0").select("machine_id", F.col("event_time").alias("responded_at"))
    assert got == {r.alert_id for r in alerts.dedupe_alerts(candidates, answers).collect()}
    assert len(got) > 50
    assert closing.late_rows(spark, out).isEmpty()
    # a late answer does not change the result, and is found
    put(feed, "late", [{"machine_id": name(1), "side": 0, "alert_id": None, "severity": None, "event_time": at(9)}])
    run()
    assert got == {r.alert_id for r in closing.results(spark, out, "opened").collect()}
    assert [(r.machine_id, r.event_time) for r in closing.late_rows(spark, out).collect()] == [(name(1), START + timedelta(seconds=9))]


def test_a_repeated_batch_replaces_itself(spark, tmp_path, monkeypatch):
    """A batch that fails at its very end runs again and leaves the same files; waiting files go when no mark names them."""
    feed, out = tmp_path / "in", str(tmp_path / "out")
    schema = "machine_id string, side int, alert_id string, severity string, event_time timestamp"
    row = lambda i, s, side=1: {"machine_id": "M1", "side": side, "alert_id": f"A{i}", "severity": "high", "event_time": at(s)}

    def run(name, *rows):
        put(feed, name, rows)
        alarms.dedupe_stream(event_time(spark.readStream.schema(schema).json(str(feed)), "event_time"), out, str(tmp_path / "cp")).awaitTermination()

    run("a", row(0, 0), row(1, 100))
    run("b", row(2, 700, 0), row(3, 800))
    run("c", row(4, 2000))

    def broken(*args):
        raise OSError("lost")

    with monkeypatch.context() as patched, pytest.raises(Exception, match="lost"):
        patched.setattr(closing, "remove", broken)
        run("d", row(5, 6000, 0), row(6, 6001))
    for name, second in (("e", 7000), ("f", 9000), ("g", 9001)):
        run(name, row(7, second))
    assert sorted(r.alert_id for r in closing.results(spark, out, "opened").collect()) == ["A0", "A3", "A6"]
    assert len([p for p in (tmp_path / "out" / "waiting").iterdir()]) <= 4


def test_a_million_rows_of_one_machine_meet_in_many_tasks(spark):
    """One machine, one minute slot after the other: no task of the pass reads more than a slot's part."""
    rows = spark.range(1_000_000).select(
        F.lit("M1").alias("machine_id"), (F.col("id") % 5 == 0).cast("int").alias("_a"), F.timestamp_micros(1_700_000_000_000_000 + F.col("id") * 7_000).alias("event_time"),
    ).selectExpr("machine_id", "1 - _a AS side", "'A' || lpad(CAST(unix_micros(event_time) AS STRING), 20, '0') AS alert_id", "'high' AS severity", "event_time")
    rule = alarms.minute_rule()
    line = alarms.instants(rows.withColumns({"due": rule.due, "until": rule.until}))
    opened, still = alarms.opened_alerts(line, spark.createDataFrame([], "machine_id string"))
    assert "Python" not in opened._jdf.queryExecution().toString() and "Arrow" not in opened._jdf.queryExecution().toString()
    assert opened.count() == 200_000 and [r.machine_id for r in still.collect()] == ["M1"]
    slots = line.groupBy(F.date_trunc("minute", "event_time").alias("m")).count()
    assert slots.count() > 100 and slots.agg(F.max("count")).first()[0] < 10_000


def test_an_event_sent_again_is_ignored(spark, tmp_path):
    feed = tmp_path / "in"
    put(feed, "a", [{"alert_id": "A1", "event_time": at(0)}, {"alert_id": "A1", "event_time": at(0)}])
    stream = lambda: alarms.dedupe_events(event_time(spark.readStream.schema("alert_id string, event_time timestamp").json(str(feed)), "event_time"))
    assert len(finish(spark, stream(), tmp_path)) == 1
    put(feed, "b", [{"alert_id": "A1", "event_time": at(60)}, {"alert_id": "A2", "event_time": at(61)}])
    assert sorted(r.alert_id for r in finish(spark, stream(), tmp_path)) == ["A1", "A2"]


def test_ingestion_job(spark, tmp_path, machines):
    feed, out = tmp_path / "in", str(tmp_path / "out")
    bad = reading(3, "M1", 2)
    bad["temperature"] = "n/a"
    put(feed, "a", [reading(1, "M1", 0, t=90.5), reading(2, "M9", 1), bad, reading(4, "M2", 86400)])
    raw = lambda: spark.readStream.text(str(feed))
    ingest.ingest(raw(), machines, out, str(tmp_path / "cp")).awaitTermination()
    put(feed, "b", [reading(5, "M2", 3, v=2.0), reading(5, "M2", 3, v=2.0), reading(1, "M1", 0, t=90.5)])
    ingest.ingest(raw(), machines, out, str(tmp_path / "cp")).awaitTermination()
    stored = ingest.read_out(spark, out, "readings")
    assert sorted(r.reading_id for r in stored.collect()) == ["R1", "R4", "R5"]
    assert stored.filter("date = DATE '2024-01-02'").count() == 1
    assert sorted(p for r in ingest.read_out(spark, out, "rejected").collect() for p in r.problems) == ["machine_id: not found", "temperature: not double"]
    assert sorted(r.type for r in ingest.read_out(spark, out, "alerts").collect()) == ["CRITICAL_TEMP", "CRITICAL_VIBE"]
    changed = ingest.read_out(spark, out, "machine_changes").select("machine_id", "risk_level", "status").collect()
    assert sorted(tuple(r) for r in changed) == [("M1", "critical", "warning"), ("M2", "critical", "warning")]
    sent = [json.loads(r.value) for r in ingest.read_out(spark, out, "events").collect()]
    assert sorted((e["type"], e["payload"]["machine_id"]) for e in sent) == [("alert_new", "M1"), ("alert_new", "M2")]


def test_ids_of_a_day_are_known(spark, tmp_path):
    days = spark.range(5000).select(F.concat(F.lit("R"), "id").alias("id"), F.date_add(F.lit("2024-01-01"), (F.col("id") % 3).cast("int")).alias("date"))
    filters = seen.SeenIds(spark, str(tmp_path / "f"), parts=8, merge_from=3)
    names = ["2024-01-01", "2024-01-02", "2024-01-03"]
    for n in range(4):
        part = days.filter(F.col("id").substr(2, 9).cast("int") % 8 == n)
        for _ in range(2):
            filters.add(part, "id", names, n)
    added = days.filter(F.col("id").substr(2, 9).cast("int") % 8 < 4)
    assert filters.known(added, "id", names).count() == added.count() == 2500
    others = days.filter(F.col("id").substr(2, 9).cast("int") % 8 >= 4)
    assert filters.known(others, "id", names).count() < 25
    assert filters.known(added.withColumn("date", F.date_add("date", 1)), "id", ["2024-01-02", "2024-01-03", "2024-01-04"]).count() < 25
    assert len(list((tmp_path / "f" / "date=2024-01-01").iterdir())) < 4


def test_a_batch_opens_only_the_files_of_its_days(spark, tmp_path, machines):
    feed, out = tmp_path / "in", str(tmp_path / "out")
    run = lambda: ingest.ingest(spark.readStream.text(str(feed)), machines, out, str(tmp_path / "cp")).awaitTermination()
    for day in range(4):
        put(feed, f"d{day}", [reading(10 * day + i, "M1", 86400 * day + i) for i in range(5)])
        run()
    held = seen.stored_ids(spark, f"{out}/readings", ["2024-01-02", "2024-01-04", "2030-01-01"], 3)
    assert {f.split("/readings/")[1].split("/part")[0] for f in held.inputFiles()} == {"date=2024-01-02/batch=1", "date=2024-01-04/batch=3"}
    assert sorted(r.reading_id for r in held.collect()) == [f"R1{i}" for i in range(5)]
    put(feed, "again", [reading(i, "M1", i) for i in range(5)] + [reading(99, "M2", 7)])
    run()
    stored = ingest.read_out(spark, out, "readings")
    assert stored.count() == 21 and stored.filter("batch = 4").select("reading_id").collect()[0][0] == "R99"


@pytest.mark.parametrize("n", [1, 3])
def test_newest_rows_after_batches_in_any_order(spark, tmp_path, n):
    import random

    rng, feed, table = random.Random(n), tmp_path / "in", str(tmp_path / "newest")
    rows = [reading(i, f"M{rng.randrange(4)}", rng.randrange(50)) for i in range(120)]
    stream = lambda: read_sensor_stream(spark, str(feed))
    feed.mkdir()
    newest.rebuild_newest(spark.createDataFrame([], stream().schema), table, n)
    for part in range(4):
        put(feed, f"p{part}", rows[part * 30 : part * 30 + 30] + rows[:3])  # some come again and again
        newest.keep_newest(stream(), table, str(tmp_path / "cp"), n=n).awaitTermination()
    got = {(r.machine_id, r.reading_id) for r in newest.newest_kept(spark, table, stream().schema, n).collect()}
    want = set()
    for m in {r["machine_id"] for r in rows}:
        want |= {(m, r["reading_id"]) for r in sorted((r for r in rows if r["machine_id"] == m), key=lambda r: (r["timestamp"], r["reading_id"]))[-n:]}
    assert got == want


def test_newest_reading_is_kept_without_the_history(spark, tmp_path, machines):
    feed, table = tmp_path / "in", str(tmp_path / "newest")
    stream = lambda: read_sensor_stream(spark, str(feed))
    put(feed, "a", [reading(1, "M1", 5), reading(2, "M1", 50, t=45.0), reading(3, "M2", 70, t=90.5)])
    schema = stream().schema
    newest.rebuild_newest(spark.createDataFrame([], schema), table)
    for name, rows in (("b", [reading(4, "M1", 20), reading(5, "M2", 2000)]), ("c", [reading(6, "M1", 60)])):
        newest.keep_newest(stream(), table, str(tmp_path / "cp")).awaitTermination()
        put(feed, name, rows)
    newest.keep_newest(stream(), table, str(tmp_path / "cp")).awaitTermination()
    kept = newest.newest_kept(spark, table, schema)
    assert {r.machine_id: r.reading_id for r in kept.collect()} == {"M1": "R6", "M2": "R5"}
    plan = scoring.score_fleet(kept, machines.withColumn("status", F.lit("normal")))
    assert all("/newest/slot=" in f for f in plan.inputFiles())


def test_ingestion_fills_time_and_id(spark, tmp_path, machines):
    feed = tmp_path / "in"
    bare = {k: v for k, v in reading(1, "M1", 0).items() if k not in ("reading_id", "timestamp")}
    put(feed, "a", [bare])
    ingest.ingest(spark.readStream.text(str(feed)), machines, str(tmp_path / "o1"), str(tmp_path / "c1")).awaitTermination()
    assert ingest.read_out(spark, str(tmp_path / "o1"), "rejected").first().problems == ["timestamp: missing"]
    timed = spark.readStream.text(str(feed)).withColumn("arrived", F.lit("2024-01-03 08:00:00").cast("timestamp"))
    ingest.ingest(timed, machines, str(tmp_path / "o2"), str(tmp_path / "c2")).awaitTermination()
    stored = ingest.read_out(spark, str(tmp_path / "o2"), "readings").first()
    assert str(stored.timestamp) == "2024-01-03 08:00:00" and len(stored.reading_id) == 32


def test_event_log_is_idempotent_and_keeps_order(spark, tmp_path):
    log = str(tmp_path / "log")
    envelope = lambda kind, s, **payload: {"value": json.dumps({"type": kind, "timestamp": at(s), "payload": payload})}
    first = [
        envelope("alert_new", 0, alert_id="A1", status="pending"), envelope("alert_new", 1, alert_id="A1", status="pending"),
        envelope("alert_escalated", 5, alert_id="A1", status="escalated"), envelope("alert_escalated", 6, alert_id="A7", status="escalated"),
        envelope("ticket_updated", 9, ticket_id="T1", status="closed"), envelope("ticket_assigned", 3, ticket_id="T1", status="assigned", mechanic_id="K1"),
        envelope("ticket_updated", 4, ticket_id="T2", mechanic_id=None), envelope("heartbeat", 4),
        envelope("mechanic_status", 4, mechanic_id="K1", login_status="busy"),
    ]
    batch = spark.createDataFrame([(r["value"],) for r in first], "value string")
    for _ in range(2):
        state.parse_envelopes(batch).write.mode("overwrite").partitionBy("entity").parquet(f"{log}/batch=0")
    state.parse_envelopes(batch.limit(0)).write.mode("overwrite").partitionBy("entity").parquet(f"{log}/batch=1")
    tickets = spark.createDataFrame([("T1", "open", None), ("T2", "assigned", "K2")], "ticket_id string, status string, mechanic_id string")
    after = state.current_state(tickets, state.read_log(spark, log, "tickets"), "ticket_id")
    assert {tuple(r) for r in after.collect()} == {("T1", "closed", "K1"), ("T2", "assigned", None)}
    shown = spark.createDataFrame([("A0", "pending", False)], "alert_id string, status string, auto_escalated boolean")
    now = state.current_alerts(shown, state.read_log(spark, log, "alerts"))
    assert {tuple(r) for r in now.collect()} == {("A0", "pending", False), ("A1", "escalated", True)}


def test_state_from_a_snapshot_equals_replay(spark, tmp_path):
    """Snapshots after any batch, events out of order behind them, ties in time, a stated null, a snapshot that was not finished."""
    import random

    rng = random.Random(4)
    base = spark.createDataFrame([(f"T{i}", "open", None) for i in range(6)], "ticket_id string, status string, mechanic_id string")
    shown = spark.createDataFrame([("A0", "pending", False)], "alert_id string, status string, auto_escalated boolean")
    rows = []
    for _ in range(300):
        kind = rng.choice(["ticket_updated", "ticket_assigned", "ticket_closed", "alert_new", "alert_escalated"])
        if kind.startswith("alert"):
            payload = {"alert_id": f"A{rng.randrange(5)}"} | ({"status": rng.choice(["pending", "escalated", "x"])} if rng.random() < 0.8 else {})
        else:
            payload = {"ticket_id": f"T{rng.randrange(8)}"} | rng.choice([{"status": rng.choice("abc")}, {"mechanic_id": rng.choice(["K1", "K2", None])}, {"status": "z", "mechanic_id": "K3"}, {}])
        rows.append((json.dumps({"type": kind, "timestamp": at(rng.randrange(60)), "payload": payload}),))
    rows.append(('{"type": "ticket_updated", "timestamp": "2024-01-01T10:00:00", "payload": {"status": "nobody"}}',))
    log = str(tmp_path / "log")
    for n in range(6):
        state.parse_envelopes(spark.createDataFrame(rows[n * 50 : n * 50 + 50 + n // 5], "value string")).write.partitionBy("entity").parquet(f"{log}/batch={n}")
        if n in (0, 3):
            state.take_snapshot(spark, log, n)
    (tmp_path / "log" / "_snapshot" / "upto=5" / "entity=tickets").mkdir(parents=True)
    both = lambda f, b, entity: [sorted(map(tuple, f(b, state.read_log(spark, log, entity, snapshots=s)).collect()), key=str) for s in (True, False)]
    for one, other in (both(lambda b, r: state.current_state(b, r, "ticket_id"), base, "tickets"), both(state.current_alerts, shown, "alerts")):
        assert one == other and len(one) >= 5
    tail = state.read_log(spark, log, "tickets")
    assert {f.split("/log/")[1].split("/entity")[0] for f in tail.inputFiles()} == {"_snapshot/upto=3", "batch=4", "batch=5"}
    assert tail.count() < state.read_log(spark, log, "tickets", snapshots=False).count()


def test_the_job_takes_snapshots_by_size(spark, tmp_path):
    feed, log = tmp_path / "in", str(tmp_path / "log")
    for n in range(3):
        put(feed, f"p{n}", [{"type": "ticket_updated", "timestamp": at(n), "payload": {"ticket_id": "T1", "status": f"s{n}"}}])
        state.apply_events(spark.readStream.text(str(feed)), log, str(tmp_path / "cp"), snapshot_after=10 if n else 1 << 30).awaitTermination()
        assert state.snapshot_mark(spark, log) == (n if n else -1)
    base = spark.createDataFrame([("T1", "open")], "ticket_id string, status string")
    rows = state.read_log(spark, log, "tickets")
    assert state.current_state(base, rows, "ticket_id").first().status == "s2" and rows.count() == 1


def test_kept_costs_equal_a_full_scan(spark, tmp_path):
    """Batches in any order, one of them twice, folds between them."""
    import random

    rng, feed, out = random.Random(2), tmp_path / "in", str(tmp_path / "out")
    rows = [{"ticket_id": rng.randrange(40), "machine_id": rng.choice(["M1", "M2", None]), "amount": rng.randrange(10_000) / 100, "month": rng.randrange(1, 13), "year": 2023 + rng.randrange(2)} for _ in range(300)]
    shape = "ticket_id long, machine_id string, amount decimal(18,2), month int, year int"
    for part in range(5):
        put(feed, f"p{part}", rows[part * 60 : part * 60 + 60])
        spending.keep_costs(spark.readStream.schema(shape).json(str(feed)), out, str(tmp_path / "cp"), fold_after=2).awaitTermination()
        if part == 3:  # the last batch again, as after a lost driver
            spending.billed_tickets(spark.read.schema(shape).json(str(feed / "p3.json"))).write.mode("overwrite").parquet(f"{out}/batch=3/billed")
    sums, billed = spending.kept_costs(spark, out)
    cost = spark.read.schema(shape).json(str(feed))
    machines = spark.createDataFrame([("M1", "Mill", 50.0)], "machine_id string, name string, health_score double")
    tickets = spark.createDataFrame([(i, i / 8) for i in range(30)], "ticket_id long, time_taken_hours double")
    for figure, kept in (
        (lambda c: finance.expenses(c, "month"), sums), (lambda c: finance.expenses(c, "year"), sums), (finance.expenses_all_grains, sums),
        (lambda c: finance.expense_breakdown(c, machines, "year"), sums), (lambda c: finance.owner_kpis(c, machines), sums),
        (lambda c: finance.avg_repair_time(tickets, c), billed), (finance.expense_trend, sums),
    ):
        assert sorted(map(str, figure(kept).collect())) == sorted(map(str, figure(cost).collect()))
    assert sums.count() < 75 and all("/out/_fold/" in f or "/out/batch=" in f for f in sums.inputFiles())
    assert spending._mark(spark, out) >= 1 and len(list((tmp_path / "out").glob("batch=*"))) <= 3


def test_tasks_over_kept_costs_grow_with_the_rows(spark, tmp_path, monkeypatch):
    shape = "ticket_id long, machine_id string, amount decimal(18,2), month int, year int"
    cost = spark.createDataFrame([(i, None if i % 9 == 0 else f"M{i % 40}", Decimal(i), i % 12 + 1, 2024) for i in range(900)], shape)
    for batch in range(2):
        for part, make in (("sums", spending.cost_sums), ("billed", spending.billed_tickets)):
            make(cost.filter(f"ticket_id % 2 = {batch}")).write.parquet(f"{tmp_path}/batch={batch}/{part}")
    monkeypatch.setattr(spending, "TASK_ROWS", 20)
    sums, billed = spending.kept_costs(spark, str(tmp_path))
    assert sums.rdd.getNumPartitions() >= 6 and billed.rdd.getNumPartitions() == 45
    assert sorted(map(str, sums.collect())) == sorted(map(str, spending.cost_sums(cost).collect()))
    assert sorted(map(str, billed.collect())) == sorted(map(str, spending.billed_tickets(cost).collect()))


def test_feed_of_envelopes(spark):
    given = spark.createDataFrame([("A1", "2024-01-01 10:00:00", "hot")], "alert_id string, at string, text string").withColumn("at", F.col("at").cast("timestamp"))
    feed = events.notification_feed(events.notices(given, "alert_new", "at", "alert_id", "text"), events.notices(given, "alert_escalated", "at", "alert_id"))
    assert sorted((r.title, r.message, r.read) for r in feed.collect()) == [("Alert Escalated", "Alert auto-escalated to Maintenance Manager", False), ("New Alert", "hot", False)]
