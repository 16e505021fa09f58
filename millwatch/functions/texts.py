"""Labels, periods, timestamps and JSON values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def month_period(year: Column, month: Column) -> Column:
    return F.concat(year.cast("string"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"))


def year_of(period: Column) -> Column:
    return F.substring(period, 1, 4)


def label(word: Column) -> Column:
    """Only the first underscore becomes a space."""
    return F.upper(F.regexp_replace(word, "^([^_]*)_", "$1 "))


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def clock(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm")


def long_clock(ts: Column) -> Column:
    return F.date_format(ts, "MMM d, HH:mm:ss")


def json_value(text: Column, field: str) -> Column:
    return F.get_json_object(text, f"$.{field}")


def json_map(text: Column) -> Column:
    return F.from_json(text, "map<string,string>")


def json_variant(text: Column) -> Column:
    """JSON text as a VARIANT, parsed once and stored in binary; null for null and for malformed text."""
    return F.try_parse_json(text)


def variant_text(value: Column, field: str) -> Column:
    """A field of a VARIANT object as text; null if it is absent, null, or no single value."""
    return F.try_variant_get(value, f"$.{field}", "string")


def variant_fields(value: Column) -> Column:
    """Names of an object's fields in order; null for anything else."""
    return F.array_sort(F.map_keys(F.try_variant_get(value, "$", "map<string,variant>")))


def number_text(value: Column) -> Column:
    """A double as text without a trailing ``.0``."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")
