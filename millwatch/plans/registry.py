"""Where queries and their SQL counterparts are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from millwatch.plans.oracle import with_views
from millwatch.session import ship_package
from millwatch.sources.demo import Demo

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, like: str | None = None):
    """Register ``build(demo)`` under a name, with the SQL it must equal if there is one, or that of the query it is another way to."""

    def add(build: Callable[[Demo], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: plain(build(_demo(spark, folder)))
        if sql or like:
            ORACLES[name] = ORACLES[like] if like else with_views(sql)
        return build

    return add


def _demo(spark: SparkSession, folder: str) -> Demo:
    ship_package(spark)
    return Demo(spark, folder)


def plain(df: DataFrame) -> DataFrame:
    """Result types that every engine has: long, double, string (also for days), boolean, zone-less timestamp."""
    casts = {}
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        if kind in ("integer", "short", "byte"):
            casts[field.name] = "bigint"
        elif kind in ("decimal", "float"):
            casts[field.name] = "double"
        elif kind == "timestamp":
            casts[field.name] = "timestamp_ntz"
        elif kind == "date":
            casts[field.name] = "string"
    return df.withColumns({name: F.col(name).cast(kind) for name, kind in casts.items()}) if casts else df
