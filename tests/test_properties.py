"""Rules that hold for any input, and brute force on skewed small data."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millwatch.functions import health, numbers
from millwatch.operators import alerts, assets, changes, production, scoring, tickets, times, validate

START = datetime(2024, 1, 1)


def test_health_is_bounded_and_falls(spark):
    grid = spark.range(0, 200).crossJoin(spark.range(0, 60).withColumnRenamed("id", "w")).select(
        (F.col("id") * 1.0).alias("t"), (F.col("w") * 0.25).alias("v")
    )
    h = health.health_score
    t, v = F.col("t"), F.col("v")
    bad = grid.filter((h(t, v) < 0) | (h(t, v) > 100) | (h(t + 1, v) > h(t, v)) | (h(t, v + 0.5) > h(t, v)))
    assert bad.count() == 0


def test_draws_stay_in_their_band(spark):
    keys = spark.range(20000).withColumn("risk", F.element_at(F.array(*[F.lit(b[0]) for b in health.RISK_BANDS]), (F.col("id") % 4 + 1).cast("int")))
    drawn = keys.withColumns({"rul": health.rul_hours(F.col("risk"), F.col("id")), "c": health.confidence(F.col("risk"), F.col("id"))})
    spans = {r.risk: r for r in drawn.groupBy("risk").agg(F.min("rul").alias("a"), F.max("rul").alias("b"), F.min("c").alias("c"), F.max("c").alias("d"), F.countDistinct("rul").alias("n")).collect()}
    for risk, _, (low, high), (cl, ch) in health.RISK_BANDS:
        s = spans[risk]
        assert low <= s.a and s.b <= high and cl <= s.c and s.d <= ch and s.n > 100


def skewed(seed: int, n: int, ties: bool):
    """A third of the rows on one machine; with ties a third at one instant too."""
    rng = random.Random(seed)
    for i in range(n):
        machine = 0 if rng.random() < 0.34 else rng.randrange(1, 12)
        at = START + timedelta(seconds=rng.randrange(0, 4 * 86400)) if not ties or rng.random() > 0.34 else START + timedelta(hours=7)
        yield i, machine, at


@pytest.mark.parametrize("ties", [False, True])
def test_prediction_in_force_equals_brute_force(spark, ties):
    predictions = list(skewed(1, 700, ties))
    asked = list(skewed(2, 900, ties))
    left = spark.createDataFrame(asked, "alert_id long, machine_id long, triggered_at timestamp")
    right = spark.createDataFrame(predictions, "prediction_id long, machine_id long, timestamp timestamp")
    got = {r.alert_id: r.prediction and r.prediction.prediction_id for r in alerts.alerts_with_prediction(left, right).collect()}
    want = {}
    for alert, machine, at in asked:
        before = [(t, p) for p, m, t in predictions if m == machine and t <= at]
        want[alert] = max(before)[1] if before else None
    assert got == want


@pytest.mark.parametrize("ties", [False, True])
def test_dedupe_equals_a_sequential_loop(spark, ties):
    candidates = [(f"A{i:05d}", m, t) for i, m, t in skewed(3, 900, ties)]
    answers = [(m, t) for _, m, t in skewed(4, 300, ties)]
    given = spark.createDataFrame(candidates, "alert_id string, machine_id long, triggered_at timestamp")
    replies = spark.createDataFrame(answers, "machine_id long, responded_at timestamp")
    got = {r.alert_id for r in alerts.dedupe_alerts(given, replies).collect()}
    line = sorted([(t, 0, "", m) for m, t in answers] + [(t, 1, a, m) for a, m, t in candidates])
    open_on, want = set(), set()
    for _, side, alert, machine in line:
        if side == 0:
            open_on.discard(machine)
        elif machine not in open_on:
            open_on.add(machine)
            want.add(alert)
    assert got == want


def test_passes_over_levels_agree(spark):
    instants = sorted({(m, t) for _, m, t in skewed(5, 800, False)})
    rows = [(m, t, i if i % 3 == 0 else None, i % 5 < 2) for i, (m, t) in enumerate(instants)]
    df = spark.createDataFrame(rows, "k long, at timestamp, v long, ask boolean")
    for name in (times.carry_forward, times.running_sum):
        given = df.fillna(0, ["v"]) if name is times.running_sum else df
        want, last = {}, {}
        for k, t, v, ask in rows:
            if name is times.running_sum:
                last[k] = last.get(k, 0) + (v or 0)
            elif v is not None:
                last[k] = v
            if ask:
                want[k, t] = last.get(k)
        for levels in ((), ("hour",), ("minute", "day"), ("second", "minute", "hour", "day")):
            got = {(r.k, r.at): r.v for r in name(given, "k", "at", "v", "ask", levels).collect()}
            assert got == want


def test_a_key_is_spread_over_its_slots(spark):
    """A hot machine's rows never meet in one window group."""
    rows = [(0, START + timedelta(seconds=5 * i), i, True) for i in range(5000)]
    df = spark.createDataFrame(rows, "k long, at timestamp, v long, ask boolean")
    plan = times.carry_forward(df, "k", "at", "v", "ask")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 2
    per_slot = df.groupBy("k", F.date_trunc(times.LEVELS[0], "at")).count().agg(F.max("count")).first()[0]
    assert per_slot == 720


def test_changes_are_idempotent_and_sequential(spark):
    rng = random.Random(6)
    columns = ["a", "b", "c"]
    base = [(k, 0, "x", None) for k in range(40)]
    stated, state = [], {k: {"a": 0, "b": "x", "c": None} for k in range(40)}
    for seq in range(600):
        key = 0 if rng.random() < 0.34 else rng.randrange(0, 45)
        chosen = [c for c in columns if rng.random() < 0.5]
        row = {"a": rng.choice([None, seq]), "b": rng.choice([None, f"s{seq}"]), "c": rng.choice([None, float(seq)])}
        stated.append((key, seq, row["a"], row["b"], row["c"], chosen))
        if key in state:
            state[key].update({c: row[c] for c in chosen})
    rng.shuffle(stated)
    before = spark.createDataFrame(base, "k int, a int, b string, c double")
    change = spark.createDataFrame(stated, "k int, seq int, a int, b string, c double, _set array<string>")
    after = changes.apply_changes(before, change, "k")
    want = {(k, v["a"], v["b"], v["c"]) for k, v in state.items()}
    assert {tuple(r) for r in after.collect()} == want
    assert {tuple(r) for r in changes.apply_changes(after, change, "k").collect()} == want


def test_insert_if_absent_keeps_every_row_once(spark):
    base = spark.createDataFrame([("a",), ("b",)], "mail string")
    incoming = spark.createDataFrame([("a", 1), ("c", 3), ("c", 2), ("d", 4), ("d", 5), ("d", 6)], "mail string, n int")
    fresh, rest = validate.insert_if_absent(base, incoming, "mail", ["n"])
    assert {tuple(r) for r in fresh.collect()} == {("c", 2), ("d", 4)}
    assert {tuple(r) for r in rest.collect()} == {("a", 1), ("c", 3), ("d", 5), ("d", 6)}


def test_insert_if_absent_with_null_keys_and_ties(spark):
    base = spark.createDataFrame([("a",), (None,)], "mail string")
    incoming = [(None, 1, "x"), (None, 2, "y"), ("c", 5, "p"), ("c", 5, "o"), ("c", 5, "o"), ("c", 5, "o"), ("a", 1, "z")]
    fresh, rest = validate.insert_if_absent(base, spark.createDataFrame(incoming, "mail string, n int, t string"), "mail", ["n"])
    assert [tuple(r) for r in fresh.collect()] == [("c", 5, "o")]
    want = list(incoming)
    want.remove(("c", 5, "o"))
    assert sorted(map(str, (tuple(r) for r in rest.collect()))) == sorted(map(str, want))


def test_sums_keep_small_and_large_values(spark):
    sums = lambda values: spark.createDataFrame([(v,) for v in values], "v double").agg(numbers.exact_sum(F.col("v")).alias("s")).first().s
    assert sums([1e-7] * 10) == 1e-6 and sums([1e12, 0.5]) == 1e12 + 0.5


def test_mean_time_to_close_is_exact(spark):
    opened = datetime(2024, 1, 1)
    rows = [(i, 1.0, opened, opened + timedelta(microseconds=us)) for i, us in enumerate((1500, 1700))]
    found = tickets.mttr(spark.createDataFrame(rows, "id int, time_taken_hours double, created_at timestamp, closed_at timestamp")).first()
    assert found.mean_hours_to_close == 3200 / 3600000000.0 / 2


def test_scoring_run_opens_alerts_only_where_none_is_open(spark):
    at = datetime(2024, 1, 1)
    readings = spark.createDataFrame([(i, f"M{i}", at, 120.0, 60.0) for i in range(4)], "reading_id int, machine_id string, timestamp timestamp, temperature double, vibration double")
    machines = spark.createDataFrame(
        [(f"M{i}", "normal", 0.0, "low", 0.0, at) for i in range(4)],
        "machine_id string, status string, health_score double, risk_level string, rul_hours double, last_updated timestamp",
    )
    alerts = spark.createDataFrame(
        [("A0", "M0", "pending", "low"), ("A1", "M1", "escalated", "medium"), ("A2", "M2", "acknowledged", "critical"), ("A3", "M2", "resolved", "critical")],
        "alert_id string, machine_id string, status string, severity string",
    )
    opened = scoring.scoring_run(readings, machines, alerts, "2024-01-02 00:00:00")["alerts"]
    assert sorted(r.machine_id for r in opened.collect()) == ["M2", "M3"]


def test_moves_are_taken_in_order(spark):
    rng = random.Random(21)
    machines = [(f"M{i}", f"name {i}", "normal") for i in range(12)]
    moves = [(f"V{s}", s, f"M{rng.randrange(14)}", f"M{rng.randrange(12)}", "u", datetime(2024, 1, 1)) for s in range(60)]
    place = {f"S{i}": (f"M{rng.randrange(12)}", "delayed", None) for i in range(40)}
    frame = spark.createDataFrame([(s, m, st, r) for s, (m, st, r) in place.items()], "schedule_id string, machine_id string, status string, delay_reason string")
    out = production.reallocate(
        spark.createDataFrame(machines, "machine_id string, name string, status string"), frame,
        spark.createDataFrame([], "ticket_id string, machine_id string, status string"),
        spark.createDataFrame(moves, "move_id string, seq int, source string, target string, user_id string, moved_at timestamp"),
    )
    names = {m: n for m, n, _ in machines}
    for _, _, source, target, _, _ in moves:
        if source in names and target in names:
            for s, (machine, _, _) in place.items():
                if machine == source:
                    place[s] = (target, "on_track", f"Reallocated from {names[source]}")
    got = {r.schedule_id: (r.machine_id, r.status, r.delay_reason) for r in out["schedules"].collect()}
    assert got == place


def test_newest_rows(spark):
    rows = list(skewed(7, 1200, True))
    df = spark.createDataFrame(rows, "reading_id long, machine_id long, timestamp timestamp")
    want = {m: max((t, i) for i, k, t in rows if k == m)[1] for _, m, _ in rows}
    assert {r.machine_id: r.reading_id for r in assets.latest_reading(df).collect()} == want
    top = assets.newest_n(df, "machine_id", "timestamp", "reading_id", 5).collect()
    for machine in want:
        ranked = sorted(((t, i) for i, k, t in rows if k == machine), reverse=True)[:5]
        assert [r.reading_id for r in sorted((r for r in top if r.machine_id == machine), key=lambda r: r.rank)] == [i for _, i in ranked]
