"""Queries that run the streaming operators over whole tables, then read what they wrote.

A stream gives only what lies behind its final watermark: the newest event time less ten minutes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millwatch.operators import alerts, assets, finance, scoring
from millwatch.plans import reports
from millwatch.plans.alarms import ALARMS, FLEET, HIGH_ALARMS, HIGH_LIMITS
from millwatch.plans.registry import query
from millwatch.session import exists, new_folder
from millwatch.sources.demo import COST_COLUMNS, READING_COLUMNS, STORED
from millwatch.sources.feed import event_time
from millwatch.streaming import alarms, closing, ingest, newest, runs, spending, state

MARK = "(SELECT date_trunc('milliseconds', max({time})) - INTERVAL 10 MINUTE FROM {rows})"


def event_files(d) -> DataFrame:
    """The events table as a stream of files."""
    return (
        d.spark.readStream.schema(STORED["events"]).format("parquet").option("pathGlobFilter", "events.parquet").load(d.folder)
    )


def reading_stream(d) -> DataFrame:
    return event_time(event_files(d).selectExpr(*READING_COLUMNS), "timestamp")


def results(d, stream: DataFrame) -> DataFrame:
    """Run a stream to the end of its input and read its files."""
    folder = new_folder(d.spark, "stream")
    runs.to_files(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return d.spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query("s2_sensor_stream", "SELECT reading_id, r.machine_id, ts AS \"timestamp\", temperature, vibration FROM fx_readings r JOIN fx_machines m ON r.machine_id = m.machine_id")
def s2(d):
    known = reading_stream(d).join(d.machines().select("machine_id"), "machine_id", "left_semi")
    return results(d, known.select("reading_id", "machine_id", "timestamp", "temperature", "vibration"))


@query("t1_alarm_stream", f"SELECT alert_id, machine_id, triggered_at, type, message FROM {HIGH_ALARMS} a")
def t1_stream(d):
    found = alerts.threshold_alerts(reading_stream(d), d.machines(), HIGH_LIMITS)
    return results(d, found.select("alert_id", "machine_id", "triggered_at", "type", "message"))


@query(
    "t2_score_stream",
    f"""SELECT prediction_id, machine_id, ts AS "timestamp", health_score, risk_level, rul_hours, failure_type, confidence FROM fx_predictions
        WHERE date_trunc('minute', ts) + INTERVAL 1 MINUTE <= {MARK.format(time='ts', rows='events')}
        QUALIFY row_number() OVER (PARTITION BY machine_id, date_trunc('minute', ts) ORDER BY ts DESC, prediction_id DESC) = 1""",
)
def t2_stream(d):
    return results(d, alarms.stream_scores(reading_stream(d)).drop("model_version"))


@query(
    "t2_score_kept",
    f"""SELECT prediction_id, machine_id, ts AS "timestamp", health_score, risk_level, rul_hours, failure_type, confidence FROM {FLEET} f""",
)
def t2_kept(d):
    """The fleet scored from the table of newest readings that a stream keeps, without a look at the history."""
    folder = new_folder(d.spark, "newest")
    readings = event_files(d).selectExpr(*READING_COLUMNS)
    newest.rebuild_newest(d.readings().limit(0).select(*readings.columns), f"{folder}/table")
    newest.keep_newest(readings, f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    kept = newest.newest_kept(d.spark, f"{folder}/table", readings.schema)
    return scoring.score_fleet(kept, d.machines()).drop("model_version")


def alert_stream(d) -> DataFrame:
    return event_time(
        event_files(d).selectExpr(*READING_COLUMNS).filter("temperature > 60").selectExpr(
            "reading_id AS alert_id", "machine_id", "timestamp AS event_time", "reading_id % 4 = 1 AS answered"
        ),
        "event_time",
    )


LINE = """alert_line AS (SELECT alert_id, machine_id, triggered_at, status = 'acknowledged' AS answered,
    triggered_at + to_minutes(alert_id % 10) AS answered_at,
    CASE WHEN date_trunc('minute', triggered_at) = triggered_at THEN triggered_at + INTERVAL 5 MINUTE
      ELSE date_trunc('minute', triggered_at) + INTERVAL 6 MINUTE END AS tick FROM fx_alerts),
  times AS (SELECT triggered_at AS t FROM alert_line UNION ALL SELECT answered_at FROM alert_line WHERE answered)"""


@query(
    "t3_escalation_stream",
    f"""WITH {LINE}
        SELECT alert_id, machine_id, triggered_at, 'escalated' AS status, true AS auto_escalated, tick AS escalated_at FROM alert_line
        WHERE NOT (answered AND answered_at <= tick) AND tick <= {MARK.format(time='t', rows='times')}""",
)
def t3_stream(d):
    """Acknowledged alerts were answered some minutes after they opened; the others never."""
    folder = new_folder(d.spark, "escalation")
    alarms.escalate_stream(alert_lines(event_files(d)), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return closing.results(d.spark, f"{folder}/out", "escalated")


def alert_lines(events: DataFrame) -> DataFrame:
    lines = events.selectExpr(*READING_COLUMNS).filter("temperature > 60").selectExpr(
        "reading_id AS alert_id", "machine_id",
        """inline(CASE WHEN reading_id % 4 = 1
             THEN array(struct('opened' AS kind, timestamp AS event_time),
                        struct('answered' AS kind, timestamp + make_dt_interval(0, 0, reading_id % 10) AS event_time))
             ELSE array(struct('opened' AS kind, timestamp AS event_time)) END)""",
    )
    return event_time(lines, "event_time")


@query(
    "t4_dedupe_stream",
    f"""WITH line AS (SELECT user_id AS machine_id, ts AS t, 0 AS side, CAST(NULL AS BIGINT) AS prediction_id, NULL AS severity
           FROM events WHERE event_type = 'signup'
         UNION ALL SELECT machine_id, ts, 1, prediction_id, risk_level FROM fx_predictions WHERE risk_level IN ('high', 'critical')),
       numbered AS (SELECT *, sum(1 - side) OVER (PARTITION BY machine_id ORDER BY t, side, md5(CAST(prediction_id AS VARCHAR) || '|alert')
           ROWS UNBOUNDED PRECEDING) AS epoch FROM line)
       SELECT * FROM (SELECT md5(CAST(prediction_id AS VARCHAR) || '|alert') AS alert_id, machine_id, t AS triggered_at, severity FROM numbered
         WHERE side = 1 QUALIFY row_number() OVER (PARTITION BY machine_id, epoch ORDER BY t, md5(CAST(prediction_id AS VARCHAR) || '|alert')) = 1) x
       WHERE date_trunc('minute', triggered_at) + INTERVAL 1 MINUTE <= {MARK.format(time='t', rows='line')}""",
)
def t4_stream(d):
    folder = new_folder(d.spark, "dedupe")
    alarms.dedupe_stream(dedupe_lines(event_files(d)), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return closing.results(d.spark, f"{folder}/out", "opened")


def dedupe_lines(events: DataFrame) -> DataFrame:
    candidates = scoring.alert_candidates(scoring.score_readings(events.selectExpr(*READING_COLUMNS))).select(
        "machine_id", F.lit(1).alias("side"), "alert_id", "severity", F.col("triggered_at").alias("event_time")
    )
    answers = events.filter("event_type = 'signup'").select(
        F.col("user_id").alias("machine_id"), F.lit(0).alias("side"), F.lit(None).cast("string").alias("alert_id"),
        F.lit(None).cast("string").alias("severity"), F.col("ts").alias("event_time"),
    )
    return event_time(candidates.unionByName(answers), "event_time")


def in_two_parts(d, start) -> str:
    """Feed a job every event but one in seven, then the missing ones, which by then are late but for those of the last minutes."""
    folder = new_folder(d.spark, "parts")
    for part, rows in enumerate(("event_id % 7 <> 3", "event_id % 7 = 3")):
        d.stored("events").filter(rows).write.mode("append").parquet(f"{folder}/in")
        stream = d.spark.readStream.schema(STORED["events"]).parquet(f"{folder}/in")
        start(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return f"{folder}/out"


LATE_MARK = "(SELECT max(t) - INTERVAL 10 MINUTE FROM {rows} WHERE event_id % 7 <> 3)"


@query(
    "t3_late_answers",
    f"""WITH line AS (SELECT event_id, alert_id, machine_id, triggered_at AS t, triggered_at + to_minutes(alert_id % 10) AS answered_at, status = 'acknowledged' AS answered
          FROM fx_alerts JOIN events ON event_id = alert_id),
        times AS (SELECT event_id, t FROM line UNION ALL SELECT event_id, answered_at FROM line WHERE answered)
        SELECT alert_id, machine_id, answered_at AS event_time FROM line
        WHERE answered AND event_id % 7 = 3 AND answered_at <= {LATE_MARK.format(rows='times')}""",
)
def t3_late(d):
    """Answers that came after the mark had passed them: stored, not dropped."""
    out = in_two_parts(d, lambda stream, *at: alarms.escalate_stream(alert_lines(stream), *at))
    return closing.late_rows(d.spark, out).filter("kind = 'answered'").select("alert_id", "machine_id", "event_time")


@query(
    "t4_late_rows",
    f"""WITH line AS (SELECT event_id, user_id AS machine_id, ts AS t, CAST(0 AS BIGINT) AS side, NULL AS alert_id FROM events WHERE event_type = 'signup'
          UNION ALL SELECT event_id, p.machine_id, p.ts, CAST(1 AS BIGINT), md5(CAST(prediction_id AS VARCHAR) || '|alert') FROM fx_predictions p
            JOIN events ON event_id = prediction_id WHERE risk_level IN ('high', 'critical'))
        SELECT machine_id, side, alert_id, t AS event_time FROM line
        WHERE event_id % 7 = 3 AND date_trunc('minute', t) + INTERVAL 1 MINUTE <= {LATE_MARK.format(rows='line')}""",
)
def t4_late(d):
    """Answers and candidates whose minute was closed when they came."""
    out = in_two_parts(d, lambda stream, *at: alarms.dedupe_stream(dedupe_lines(stream), *at))
    return closing.late_rows(d.spark, out).select("machine_id", "side", "alert_id", "event_time")


@query("t5_dedupe_events", "SELECT alert_id, machine_id, triggered_at FROM fx_alerts")
def t5(d):
    """Every alert is sent twice and taken once."""
    once = alert_stream(d).select("alert_id", "machine_id", F.col("event_time").alias("triggered_at"))
    return results(d, alarms.dedupe_events(once.union(once)))


def envelopes_of(events: DataFrame) -> DataFrame:
    """An envelope per event: work on tickets, mechanics who log in, and escalations."""
    return events.selectExpr(
        """to_json(struct(
             CASE event_type WHEN 'view' THEN 'ticket_updated' WHEN 'click' THEN 'ticket_assigned' WHEN 'purchase' THEN 'ticket_closed'
               WHEN 'signup' THEN 'mechanic_status' ELSE 'alert_escalated' END AS type,
             date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") AS timestamp,
             CASE event_type
               WHEN 'view' THEN map('ticket_id', CAST(floor(event_id / 2) AS STRING), 'status', 'in_progress', 'mechanic_id', NULL)
               WHEN 'click' THEN map('ticket_id', CAST(floor(event_id / 2) AS STRING), 'mechanic_id', CAST(user_id AS STRING))
               WHEN 'purchase' THEN map('ticket_id', CAST(floor(event_id / 2) AS STRING), 'status', 'closed')
               WHEN 'signup' THEN map('mechanic_id', CAST((event_id % 17) * 6 + 1 AS STRING), 'login_status', IF(event_id % 2 = 0, 'busy', 'available'))
               ELSE map('alert_id', CAST(event_id AS STRING), 'status', 'escalated') END AS payload),
           map('ignoreNullFields', 'false')) AS value"""
    )


def _logged(d, entity: str) -> DataFrame:
    folder = new_folder(d.spark, "events")
    state.apply_events(envelopes_of(event_files(d)), f"{folder}/log", f"{folder}/checkpoint").awaitTermination()
    return state.read_log(d.spark, f"{folder}/log", entity)


def _texts(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


LATEST = """(SELECT {key} AS k, {value} AS v FROM events WHERE event_type IN ({kinds})
  QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY ts DESC) = 1)"""


@query(
    "t6_ticket_state",
    f"""SELECT CAST(t.ticket_id AS VARCHAR) AS ticket_id, coalesce(s.v, t.status) AS status,
          CAST(CASE WHEN m.k IS NULL THEN t.mechanic_id ELSE m.v END AS VARCHAR) AS mechanic_id
        FROM fx_tickets t
        LEFT JOIN {LATEST.format(key="event_id // 2", value="CASE event_type WHEN 'view' THEN 'in_progress' ELSE 'closed' END", kinds="'view', 'purchase'")} s
          ON s.k = t.ticket_id
        LEFT JOIN {LATEST.format(key="event_id // 2", value="CASE event_type WHEN 'click' THEN user_id END", kinds="'view', 'click'")} m ON m.k = t.ticket_id""",
)
def t6(d):
    base = _texts(d.tickets().select("ticket_id", "status", "mechanic_id"), "ticket_id", "mechanic_id")
    return state.current_state(base, _logged(d, "tickets"), "ticket_id")


@query(
    "t6_mechanic_state",
    f"""SELECT CAST(m.mechanic_id AS VARCHAR) AS mechanic_id, coalesce(s.v, m.login_status) AS login_status FROM fx_mechanics m
        LEFT JOIN {LATEST.format(key="(event_id % 17) * 6 + 1", value="CASE WHEN event_id % 2 = 0 THEN 'busy' ELSE 'available' END", kinds="'signup'")} s
          ON s.k = m.mechanic_id""",
)
def t6_mechanics(d):
    base = _texts(d.mechanics().select("mechanic_id", "login_status"), "mechanic_id")
    return state.current_state(base, _logged(d, "mechanics"), "mechanic_id")


@query(
    "t6_alert_state",
    """SELECT CAST(alert_id AS VARCHAR) AS alert_id, CASE WHEN event_type = 'error' THEN 'escalated' ELSE status END AS status,
         event_type = 'error' AS auto_escalated FROM fx_alerts JOIN events ON event_id = alert_id""",
)
def t6_alerts(d):
    base = _texts(d.alerts().select("alert_id", "status", F.lit(False).alias("auto_escalated")), "alert_id")
    return state.current_alerts(base, _logged(d, "alerts"))


def with_new_alerts(events: DataFrame) -> DataFrame:
    """The envelopes, and an ``alert_new`` for every third alert (not in the base) and for some that the base has already."""
    added = events.selectExpr(*READING_COLUMNS).filter("temperature > 60 AND (reading_id % 3 = 0 OR reading_id % 5 = 0)").selectExpr(
        """to_json(struct('alert_new' AS type, date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") AS timestamp,
             map('alert_id', CAST(reading_id AS STRING), 'status', 'pending') AS payload)) AS value"""
    )
    return envelopes_of(events).unionByName(added)


ADDED = """SELECT CAST(alert_id AS VARCHAR) AS alert_id, CASE WHEN event_type = 'error' THEN 'escalated' WHEN alert_id % 3 = 0 THEN 'pending' ELSE status END AS status,
  event_type = 'error' AS auto_escalated FROM fx_alerts JOIN events ON event_id = alert_id"""


def _alerts_after(d, log: DataFrame) -> DataFrame:
    base = d.alerts().filter("alert_id % 3 <> 0").select("alert_id", "status", F.lit(False).alias("auto_escalated"))
    known = state.current_alerts(_texts(base, "alert_id"), log)
    return known.withColumn("auto_escalated", F.coalesce("auto_escalated", F.lit(False)))


@query("t6_alerts_added", ADDED)
def t6_added(d):
    """New alerts enter once, known ones are not added again, escalations follow."""
    folder = new_folder(d.spark, "events")
    state.apply_events(with_new_alerts(event_files(d)), f"{folder}/log", f"{folder}/checkpoint").awaitTermination()
    return _alerts_after(d, state.read_log(d.spark, f"{folder}/log", "alerts"))


@query("t6_alerts_from_snapshot", ADDED)
def t6_snapshot(d):
    """The same from a snapshot that the job took after its first batch, and the batch behind it."""
    out = in_two_parts(d, lambda stream, log, checkpoint: state.apply_events(
        with_new_alerts(stream), log, checkpoint, snapshot_after=0 if not state.folders(d.spark, log, "batch=") else None))
    return _alerts_after(d, state.read_log(d.spark, out, "alerts"))


def sent_readings(events: DataFrame) -> DataFrame:
    """Readings as the JSON that machines send."""
    return events.selectExpr(*READING_COLUMNS).selectExpr(
        """to_json(struct(CAST(reading_id AS STRING) AS reading_id, CAST(machine_id AS STRING) AS machine_id,
             date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") AS timestamp, temperature, vibration, pressure, current, rpm, noise_level)) AS value"""
    )


def ingested(d, machines: DataFrame) -> str:
    """The whole ingestion job in two runs; the second sends one reading in ten again."""
    folder = new_folder(d.spark, "ingest")
    for rows in ("event_id % 7 <> 3", "event_id % 7 = 3 OR event_id % 10 = 0"):
        d.stored("events").filter(rows).write.mode("append").parquet(f"{folder}/in")
        raw = sent_readings(d.spark.readStream.schema(STORED["events"]).parquet(f"{folder}/in"))
        ingest.ingest(raw, machines, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return f"{folder}/out"


@query(
    "s2_ingested",
    """SELECT reading_id, r.machine_id, ts AS "timestamp", temperature, vibration, strftime(ts, '%Y-%m-%d') AS date
       FROM fx_readings r JOIN fx_machines m ON r.machine_id = m.machine_id""",
)
def s2_ingested(d):
    """Every reading of a known machine is stored once, in its day's folder, however often it is sent."""
    return ingest.read_out(d.spark, ingested(d, d.machines()), "readings").select(
        F.col("reading_id").cast("bigint"), F.col("machine_id").cast("bigint"), "timestamp", "temperature", "vibration", "date"
    )


@query(
    "s2_ingest_alerts",
    f"""SELECT alert_id, machine_id, type, triggered_at FROM {ALARMS} a""",
)
def s2_alerts(d):
    """One envelope per alarm of a reading that is new."""
    sent = state.parse_envelopes(ingest.read_out(d.spark, ingested(d, d.machines()), "events").select("value"))
    part = lambda name: F.get_json_object("payload", f"$.{name}")
    return sent.select(part("alert_id").alias("alert_id"), part("machine_id").cast("bigint").alias("machine_id"), part("type").alias("type"), F.col("event_time").alias("triggered_at"))


@query(
    "s2_ingest_rejected",
    """SELECT reading_id, 'machine_id: not found' AS problem,
         CAST(CASE WHEN reading_id % 10 = 0 AND reading_id % 7 <> 3 THEN 2 ELSE 1 END AS BIGINT) AS times
       FROM fx_readings WHERE machine_id NOT IN (SELECT machine_id FROM fx_machines WHERE machine_id % 9 <> 4)""",
)
def s2_rejected(d):
    """Readings of machines that the job does not know, each time they come."""
    gone = ingest.read_out(d.spark, ingested(d, d.machines().filter("machine_id % 9 <> 4")), "rejected")
    return gone.select(F.get_json_object("value", "$.reading_id").cast("bigint").alias("reading_id"), F.explode("problems").alias("problem")).groupBy("reading_id", "problem").agg(F.count("*").alias("times"))


def kept(d, n: int) -> tuple[DataFrame, DataFrame]:
    """Tables of the n newest readings and the newest prediction per machine, as two jobs keep them over several batches."""
    def run(stream, out, checkpoint):
        jobs = []
        for name, rows, many, row_id in parts(stream):
            if not exists(d.spark, f"{out}/{name}"):
                newest.rebuild_newest(d.spark.createDataFrame([], rows.schema), f"{out}/{name}", many, row_id)
            jobs.append(newest.keep_newest(rows, f"{out}/{name}", f"{checkpoint}/{name}", n=many, row_id=row_id))
        jobs[0].awaitTermination()
        return jobs[1]

    def parts(events):
        readings = events.selectExpr(*READING_COLUMNS)
        return ("readings", readings, n, "reading_id"), ("predictions", scoring.score_readings(readings), 1, "prediction_id")

    out = in_two_parts(d, run)
    return tuple(newest.newest_kept(d.spark, f"{out}/{name}", rows.schema, many, row_id) for name, rows, many, row_id in parts(d.stored("events")))


@query("w3_latest_kept", like="w3_latest_per_machine")
def w3_kept(d):
    """The newest ten readings per machine from the kept table."""
    return assets.latest_per_machine(kept(d, 10)[0], d.machines()).select("machine_id", "reading_id", "rank")


@query("j10_machine_detail_kept", like="j10_machine_detail")
def j10_kept(d):
    """Machine detail without a look at the history."""
    return reports.detail_columns(assets.machine_detail(d.machines(), *kept(d, 24), d.alerts()))


@query("j11_fleet_snapshot_kept", like="j11_fleet_snapshot")
def j11_kept(d):
    """The snapshot that a screen polls, from one reading and one prediction per machine."""
    return reports.snapshot_columns(assets.fleet_snapshot(d.machines(), *kept(d, 1)))


def kept_costs(d) -> tuple[DataFrame, DataFrame]:
    """Cost sums as the job keeps them over three batches, the first two folded."""
    folder = new_folder(d.spark, "costs")
    orders = d.stored("orders").select("o_orderkey", "o_custkey")
    for part in range(3):
        d.stored("lineitem").filter(f"l_orderkey % 3 = {part}").write.mode("append").parquet(f"{folder}/in")
        lines = d.spark.readStream.schema(STORED["lineitem"]).parquet(f"{folder}/in")
        cost = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(*COST_COLUMNS)
        spending.keep_costs(cost, f"{folder}/out", f"{folder}/checkpoint", fold_after=2).awaitTermination()
    return spending.kept_costs(d.spark, f"{folder}/out")


@query("a2_both_grains_kept", like="a2_both_grains")
def a2_kept(d):
    """Expenses of months and years from the kept sums."""
    return finance.expenses_all_grains(kept_costs(d)[0])


@query("a3_expense_breakdown_kept", like="a3_expense_breakdown")
def a3_kept(d):
    """Cost by period and machine, one kept row for each."""
    return finance.expense_breakdown(kept_costs(d)[0], d.machines())


@query("a5_avg_repair_time_kept", like="a5_avg_repair_time")
def a5_kept(d):
    """Mean repair time over the kept pairs of month and ticket."""
    return finance.avg_repair_time(d.tickets(), kept_costs(d)[1])


@query("a14_owner_kpis_kept", like="a14_owner_kpis")
def a14_kept(d):
    """The owner's figures from the kept sums."""
    return finance.owner_kpis(kept_costs(d)[0], d.machines())
