"""Declared tables, checks, the partitioned sink and the shared folder."""

import json

from pyspark.sql import functions as F

from millwatch.operators import admin, events, validate
from millwatch.schemas import TABLES
from millwatch.session import new_folder, shared_folder
from millwatch.sources import tables


def test_load_fills_declared_defaults(spark, tmp_path):
    folder = tmp_path / "production_schedules"
    folder.mkdir()
    lines = [{"schedule_id": "S1", "machine_id": "M1", "product": "gears"}, {"schedule_id": "S2", "machine_id": "M1", "units_planned": 5, "status": "halted"}]
    (folder / "part.json").write_text("\n".join(map(json.dumps, lines)))
    df = tables.load_table(spark, str(tmp_path), "production_schedules", "json")
    assert df.schema.simpleString() == TABLES["production_schedules"].simpleString()
    assert {(r.schedule_id, r.status, r.units_planned) for r in df.collect()} == {("S1", "on_track", 1000), ("S2", "halted", 5)}


def test_load_csv_and_parquet(spark, tmp_path):
    folder = tmp_path / "users"
    folder.mkdir()
    (folder / "part.csv").write_text("user_id,name,email,role,is_active,created_at\nU1,Ann,ann@example.com,admin,,2024-01-01T00:00:00\n")
    df = tables.load_table(spark, str(tmp_path), "users", "csv")
    assert df.first().is_active is True
    out = str(tmp_path / "again")
    df.write.parquet(f"{out}/users")
    assert tables.load_table(spark, out, "users").first().email == "ann@example.com"


def test_every_table_conforms_from_nothing(spark):
    for name, schema in TABLES.items():
        df = tables.conform(spark.range(1).select(F.lit("x").alias(schema.fields[0].name)), name)
        assert [(f.name, f.dataType) for f in df.schema.fields] == [(f.name, f.dataType) for f in schema.fields]


def test_day_folders_are_pruned(spark, tmp_path):
    path = str(tmp_path / "readings")
    readings = spark.range(3000).selectExpr(
        "id AS reading_id", "IF(id % 3 = 0, 0, id % 20) AS machine_id",
        "timestamp_seconds(1704067200 + id * 120) AS timestamp", "id * 1.0D AS temperature",
    )
    tables.write_readings(readings, path)
    day = tables.read_readings(spark, path, "2024-01-02", "2024-01-02")
    assert day.count() == readings.filter("to_date(timestamp) = DATE '2024-01-02'").count() == 720
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
    tables.write_readings(readings.limit(10), path)
    assert tables.read_readings(spark, path).count() == 3010


def test_rejects_name_every_problem(spark):
    raw = spark.createDataFrame(
        [('{"machine_id":"M1","temperature":"x","vibration":1,"pressure":1,"current":1,"rpm":1,"noise_level":1}',), ("not json",)], "value string"
    )
    fields = ["reading_id", "machine_id", "timestamp", "temperature", "vibration", "pressure", "current", "rpm", "noise_level"]
    spec = validate.SPECS["sensor_readings"]
    parsed = validate.parse_json(raw, "value", spec, fields)
    valid, rejected = validate.validate(parsed, spec)
    assert valid.count() == 0
    found = {r.value[:8]: r.problems for r in rejected.collect()}
    assert found['{"machin'] == ["temperature: not double"]
    assert len(found["not json"]) == 7


def test_optional_words_may_be_missing(spark):
    given = spark.createDataFrame([("M1", "high", None, None), ("M1", "huge", "pending", "maybe")], "machine_id string, severity string, status string, operator_response string")
    valid, rejected = validate.validate(given, validate.SPECS["alerts"])
    assert valid.count() == 1
    assert rejected.first().problems == ["severity: not allowed", "operator_response: not allowed"]


def test_defaults_of_a_reading(spark):
    sent = spark.createDataFrame([(None, None, None, 1.0, 2.0, "M7")], "reading_id string, machine_id string, timestamp timestamp, temperature double, vibration double, address string")
    one = validate.with_defaults(sent, "2024-01-01 00:00:00", "address").first()
    again = validate.with_defaults(sent, "2024-01-01 00:00:00", "address").first()
    assert one.machine_id == "M7" and str(one.timestamp) == "2024-01-01 00:00:00" and one.reading_id == again.reading_id


def test_normalize_ids_keeps_null(spark):
    given = spark.createDataFrame([("0000-01", None), ("00", "a-b-c")], "a string, b string")
    assert {tuple(r) for r in validate.normalize_ids(given, ["a", "b"]).collect()} == {("000001", None), ("00", "abc")}


def test_envelope_keeps_nulls(spark):
    given = spark.createDataFrame([("A1", None)], "alert_id string, response string").withColumn("at", F.lit("2024-01-01 10:00:00").cast("timestamp"))
    body = json.loads(events.to_event_json(given, "alert_new", "at").first().value)
    assert body == {"type": "alert_new", "timestamp": "2024-01-01T10:00:00.000000", "payload": {"alert_id": "A1", "response": None, "at": "2024-01-01T10:00:00.000000"}}


def test_users_are_created_once(spark):
    users = spark.createDataFrame([("U1", "Ann", "ann@example.com", "admin", True)], "user_id string, name string, email string, role string, is_active boolean")
    staff = spark.createDataFrame([("K1", "Electrical", "available")], "mechanic_id string, skill_type string, login_status string")
    incoming = spark.createDataFrame([("U2", "Ann 2", "ann@example.com", "admin", True), ("U3", "Raj", "raj@example.com", "mechanic", True)], "user_id string, name string, email string, role string, is_active boolean")
    now, profiles, rejected = admin.create_users(users, staff, incoming, ["user_id"])
    assert {r.user_id for r in now.collect()} == {"U1", "U3"}
    assert {(r.mechanic_id, r.skill_type, r.login_status) for r in profiles.collect()} == {("K1", "Electrical", "available"), ("U3", None, "offline")}
    assert [(r.user_id, r.reason) for r in rejected.collect()] == [("U2", "Email already registered")]


def test_shared_folder_is_the_session_setting(spark):
    setting = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert shared_folder(spark) == (setting or spark.sparkContext.getCheckpointDir()).rstrip("/")
    assert new_folder(spark, "x") != new_folder(spark, "x")
