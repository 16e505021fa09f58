"""Checks and normalisation of incoming rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from millwatch import schemas
from millwatch.operators.times import moment


@dataclass(frozen=True)
class Spec:
    """What a row must satisfy: present columns, castable columns (to a type), word domains."""

    required: list[str] = field(default_factory=list)
    types: dict[str, str] = field(default_factory=dict)
    domains: dict[str, list[str]] = field(default_factory=dict)
    patterns: dict[str, str] = field(default_factory=dict)


#: Forms of text columns for a Spec's ``patterns``. Ids are checked only where a caller asks: keys may be numbers.
UUID_FORM = "^[0-9a-fA-F]{8}-?([0-9a-fA-F]{4}-?){3}[0-9a-fA-F]{12}$"
EMAIL_FORM = "^[^@\\s]+@[^@\\s.]+(\\.[^@\\s.]+)+$"


SPECS = {
    "sensor_readings": Spec(
        required=["machine_id", *schemas.SENSORS],
        types={"timestamp": "timestamp", **{s: "double" for s in schemas.SENSORS}},
    ),
    "machines": Spec(
        required=["name", "location", "type"],
        types={"health_score": "double", "rul_hours": "double"},
        domains={"risk_level": schemas.RISK_LEVELS, "status": schemas.MACHINE_STATUSES},
    ),
    "alerts": Spec(
        required=["machine_id", "severity"],
        domains={
            "severity": schemas.SEVERITIES, "status": schemas.ALERT_STATUSES,
            "operator_response": schemas.OPERATOR_RESPONSES,
        },
    ),
    "tickets": Spec(
        required=["machine_id", "description"],
        types={"repair_cost": "decimal(18,2)", "time_taken_hours": "double", "escalated": "boolean"},
        domains={"status": schemas.TICKET_STATUSES},
    ),
    "users": Spec(
        required=["name", "email", "role"], types={"is_active": "boolean"}, domains={"role": schemas.ROLES},
        patterns={"email": EMAIL_FORM},
    ),
    "mechanics": Spec(domains={"login_status": schemas.MECHANIC_STATUSES}),
    "production_schedules": Spec(
        required=["machine_id", "product"], types={"units_planned": "int"}, domains={"status": schemas.SCHEDULE_STATUSES}
    ),
}


def with_problems(df: DataFrame, spec: Spec) -> DataFrame:
    """All findings of a row in ``problems``; optional columns may be null or absent."""
    found = []
    for column in spec.required:
        missing = F.col(column).isNull() if column in df.columns else F.lit(True)
        found.append(F.when(missing, F.lit(f"{column}: missing")))
    for column, kind in spec.types.items():
        if column in df.columns:
            bad = F.col(column).isNotNull() & F.col(column).cast("string").try_cast(kind).isNull()
            found.append(F.when(bad, F.lit(f"{column}: not {kind}")))
    for column, words in spec.domains.items():
        if column in df.columns:
            found.append(F.when(~F.col(column).isin(words), F.lit(f"{column}: not allowed")))
    for column, form in spec.patterns.items():
        if column in df.columns:
            found.append(F.when(~F.col(column).cast("string").rlike(form), F.lit(f"{column}: not of its form")))
    return df.withColumn("problems", F.array_compact(F.array(*found)))


def validate(df: DataFrame, spec: Spec) -> tuple[DataFrame, DataFrame]:
    """Rows that satisfy the spec, typed; and rejected rows with their problems."""
    checked = with_problems(df, spec)
    valid = checked.filter(F.size("problems") == 0).drop("problems")
    typed = {c: F.col(c).try_cast(kind) for c, kind in spec.types.items() if c in df.columns}
    return valid.withColumns(typed), checked.filter(F.size("problems") > 0)


def parse_json(raw: DataFrame, column: str, spec: Spec, columns: list[str]) -> DataFrame:
    """Fields of a JSON text as strings, ready to validate; a text that does not parse has only nulls."""
    schema = ", ".join(f"`{c}` STRING" for c in columns)
    return raw.withColumn("_body", F.from_json(column, schema)).select(*raw.columns, "_body.*")


def reject_orphans(readings: DataFrame, machines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readings of known machines, and readings of unknown ones."""
    known = machines.select("machine_id").distinct()
    return readings.join(known, "machine_id", "left_semi"), readings.join(known, "machine_id", "left_anti")


def with_defaults(readings: DataFrame, as_of: str | Column, machine_id: str | None = None) -> DataFrame:
    """Fill what a sender may leave out: machine from the address column, time of arrival, and an id
    that is a function of the content."""
    filled = readings
    if machine_id is not None:
        filled = filled.withColumn("machine_id", F.coalesce("machine_id", F.col(machine_id)))
    arrival = moment(as_of, readings, "timestamp") if isinstance(as_of, str) else as_of
    filled = filled.withColumn("timestamp", F.coalesce("timestamp", arrival.cast(readings.schema["timestamp"].dataType)))
    content = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("machine_id", "timestamp", "temperature", "vibration")]
    return filled.withColumn("reading_id", F.coalesce(F.col("reading_id").cast("string"), F.md5(F.concat_ws("|", *content))))


def insert_if_absent(base: DataFrame, incoming: DataFrame, key: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """New rows by key, the first of the batch in ``order`` winning; and the rest, each incoming row once.

    A tie in ``order`` is settled by the other columns; of rows that are the same in all columns one is new and the others are
    rest. Rows without a key are rest. Incoming copies of a key merge before the shuffle.
    """
    columns = [*order, *[c for c in incoming.columns if c not in order]]
    row = F.struct(*columns)
    keyed = incoming.filter(F.col(key).isNotNull())
    first = keyed.groupBy(key).agg(F.min(row).alias("_row"))
    fresh = first.join(base.select(key).distinct(), key, "left_anti")
    matched = keyed.join(fresh.select(key, F.col("_row").alias("_winner")), key, "left")
    lost = matched.filter(~row.eqNullSafe(F.col("_winner"))).drop("_winner")
    same = matched.filter(row.eqNullSafe(F.col("_winner"))).groupBy(*columns).agg(F.count("*").alias("_n")).filter("_n > 1")
    copies = same.withColumn("_n", F.explode(F.sequence(F.lit(2), F.col("_n")))).drop("_n")
    rest = lost.unionByName(copies).unionByName(incoming.filter(F.col(key).isNull()))
    return fresh.select(*[F.col(f"_row.{c}").alias(c) for c in incoming.columns]), rest


def normalize_ids(df: DataFrame, columns: list[str]) -> DataFrame:
    """Ids without hyphens."""
    return df.withColumns({c: F.regexp_replace(c, "-", "") for c in columns})
