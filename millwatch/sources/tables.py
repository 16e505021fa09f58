"""Scan of the declared tables, and the time-partitioned sink of the readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millwatch.schemas import DEFAULTS, TABLES


def load_table(spark: SparkSession, folder: str, name: str, source: str = "parquet", **options) -> DataFrame:
    """A table in its declared schema, with the declared defaults for missing values."""
    reader = spark.read.schema(TABLES[name]).format(source)
    if source == "csv":
        reader = reader.option("header", True)
    return fill_defaults(reader.options(**options).load(f"{folder}/{name}"), name)


def fill_defaults(df: DataFrame, name: str) -> DataFrame:
    defaults = DEFAULTS.get(name, {})
    return df.withColumns(
        {c: F.coalesce(df[c], F.lit(v).cast(df.schema[c].dataType)) for c, v in defaults.items() if c in df.columns}
    )


def conform(df: DataFrame, name: str) -> DataFrame:
    """Bring a foreign frame to the declared schema: absent columns are null, then defaulted."""
    columns = [
        (df[field.name] if field.name in df.columns else F.lit(None)).cast(field.dataType).alias(field.name)
        for field in TABLES[name].fields
    ]
    return fill_defaults(df.select(columns), name)


def write_readings(readings: DataFrame, path: str, mode: str = "append") -> None:
    """Append readings under ``date=`` folders, ordered by machine and time inside each file.

    The rebalance hint lets adaptive execution split a date that holds much of the data
    over several writers and join small dates into one.
    """
    (
        readings.withColumn("date", F.to_date("timestamp"))
        .hint("rebalance", F.col("date"))
        .sortWithinPartitions("date", "machine_id", "timestamp")
        .write.mode(mode).partitionBy("date").parquet(path)
    )


def read_readings(spark: SparkSession, path: str, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    """Stored readings; the day bounds prune folders."""
    readings = spark.read.parquet(path)
    if first_day:
        readings = readings.filter(F.col("date") >= F.lit(first_day).cast("date"))
    if last_day:
        readings = readings.filter(F.col("date") <= F.lit(last_day).cast("date"))
    return readings
