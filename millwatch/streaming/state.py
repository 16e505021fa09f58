"""Event fan-out: envelopes go to a change log, from which the current tables are read.

A micro-batch writes only its own rows, under its batch number, so a repeated batch replaces itself
and the cost of a batch does not depend on the size of the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from millwatch.operators.changes import SET, apply_changes
from millwatch.operators.validate import insert_if_absent
from millwatch.session import exists, folders, remove, size_of
from millwatch.streaming.runs import each_batch

# Which table each kind of event changes.
ROUTES = {
    "alert_new": "alerts",
    "alert_escalated": "alerts",
    "ticket_assigned": "tickets",
    "ticket_updated": "tickets",
    "ticket_closed": "tickets",
    "mechanic_status": "mechanics",
}
PAYLOADS = "type string, event_time timestamp, payload string"
#: The key of each table.
KEYS = {"alerts": "alert_id", "tickets": "ticket_id", "mechanics": "mechanic_id"}


def parse_envelopes(events: DataFrame, column: str = "value") -> DataFrame:
    """Type, time and payload text of JSON envelopes; kinds without a table are left out."""
    kind = F.get_json_object(column, "$.type")
    entity = F
    for name, table in ROUTES.items():
        entity = entity.when(F.col("type") == name, table)
    return (
        events.select(
            kind.alias("type"), F.get_json_object(column, "$.timestamp").try_cast("timestamp").alias("event_time"),
            F.get_json_object(column, "$.payload").alias("payload"),
        )
        .withColumn("entity", entity)
        .filter(F.col("entity").isNotNull())
    )


def apply_events(
    events: DataFrame, log: str, checkpoint: str, every: str | None = None, snapshot_after: int | None = None, keys: dict[str, str] = KEYS
):
    """Start the query that appends envelopes to the change log.

    With ``snapshot_after`` the job takes a snapshot whenever the files behind the last one have more bytes than that, so that a
    reader's cost follows the changed rows and not the age of the log.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        parse_envelopes(batch).write.mode("overwrite").partitionBy("entity").parquet(f"{log}/batch={batch_id}")
        if snapshot_after is not None and sum(size_of(spark, f"{log}/batch={n}") for n in _behind(spark, log, snapshot_mark(spark, log))) > snapshot_after:
            take_snapshot(spark, log, batch_id, keys)

    return each_batch(events, append, checkpoint, every)


def snapshot_mark(spark: SparkSession, log: str) -> int:
    """The last batch that a finished snapshot holds, -1 without one."""
    return max((n for n in folders(spark, f"{log}/_snapshot", "upto=") if exists(spark, f"{log}/_snapshot/upto={n}/_done")), default=-1)


def _behind(spark: SparkSession, log: str, mark: int) -> list[int]:
    return [n for n in folders(spark, log, "batch=") if n > mark]


def read_log(spark: SparkSession, log: str, entity: str, snapshots: bool = True) -> DataFrame:
    """Log rows of one table: the last snapshot's and those of the batches behind it; no other folder is opened."""
    mark = snapshot_mark(spark, log) if snapshots else -1
    paths = [f"{log}/batch={n}/entity={entity}" for n in _behind(spark, log, mark)]
    paths += [f"{log}/_snapshot/upto={mark}/entity={entity}"] * (mark >= 0)
    paths = [p for p in paths if exists(spark, p)]
    rows = spark.read.schema(PAYLOADS).parquet(*paths) if paths else spark.createDataFrame([], PAYLOADS)
    return rows.withColumn("entity", F.lit(entity))


def still_told(log: DataFrame, key: str) -> DataFrame:
    """The rows of a log that its state depends on: the last of a kind, and the last to state a column, for each key; of added rows
    the first. As many rows a key as it has columns and kinds at most; told again with what follows they give the same state."""
    told = log.select(
        "type", "event_time", "payload", F.get_json_object("payload", f"$.{key}").alias("_key"), (F.col("type") == "alert_new").alias("_added"),
        F.explode(F.array_append(F.json_object_keys("payload"), F.concat(F.lit("/"), "type"))).alias("_column"),
    ).filter(F.col("_key").isNotNull())
    told = told.withColumn("_column", F.when(F.col("_added"), F.lit("/new")).otherwise(F.col("_column")))
    kept = told.groupBy("_key", "_column").agg(F.min(F.when(F.col("_added"), _order())).alias("_first"), F.max(F.when(~F.col("_added"), _order())).alias("_last"))
    return kept.select(F.coalesce("_first", "_last").alias("_row")).select("_row.*").distinct().select("type", "event_time", "payload")


def take_snapshot(spark: SparkSession, log: str, upto: int, keys: dict[str, str] = KEYS) -> None:
    """Write what is still told up to a batch, from the last snapshot and the batches behind it. Batches stay; the snapshot before
    the last goes. A snapshot that was not finished is written again."""
    before = [n for n in folders(spark, f"{log}/_snapshot", "upto=") if n < upto]
    for entity, key in keys.items():
        still_told(read_log(spark, log, entity), key).write.mode("overwrite").parquet(f"{log}/_snapshot/upto={upto}/entity={entity}")
    spark.range(1).write.mode("overwrite").parquet(f"{log}/_snapshot/upto={upto}/_done")
    for n in before[:-1]:
        remove(spark, f"{log}/_snapshot/upto={n}")


def _order() -> Column:
    return F.struct("event_time", "type", "payload")


def _stated(log: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """Log rows as partial updates: the fields of the payload are what it states."""
    shape = StructType([StructField(f.name, f.dataType) for f in base.schema.fields])
    return log.select(
        F.from_json("payload", shape).alias("_p"), F.json_object_keys("payload").alias(SET), _order().alias("seq")
    ).select(F.col(f"_p.{key}").alias(key), *[F.col(f"_p.{c}").alias(c) for c in base.columns if c != key], SET, "seq")


def current_state(base: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """Base rows after the logged updates; events of unknown keys have no effect."""
    return apply_changes(base, _stated(log, base, key), key)


def current_alerts(base: DataFrame, log: DataFrame) -> DataFrame:
    """Alerts after the log: new ids are added once, then updates apply; an escalation states ``auto_escalated`` by itself."""
    shape = StructType([StructField(f.name, f.dataType) for f in base.schema.fields])
    new = log.filter(F.col("type") == "alert_new").select(
        F.from_json("payload", shape).alias("_p"), _order().alias("_seq")
    ).select("_p.*", "_seq").filter(F.col("alert_id").isNotNull())
    added, _ = insert_if_absent(base, new, "alert_id", ["_seq"])
    everything = base.unionByName(added.drop("_seq"))
    changed = _stated(log.filter(F.col("type") == "alert_escalated"), everything, "alert_id").withColumns(
        {"auto_escalated": F.lit(True), SET: F.array_union(SET, F.array(F.lit("auto_escalated")))}
    )
    return apply_changes(everything, changed, "alert_id")

