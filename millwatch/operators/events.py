"""Event envelopes, the notification feed and cascading deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millwatch.functions.texts import iso_time

# Title, message and link of the notice for each kind of event.
NOTICES = {
    "alert_new": ("New Alert", "Machine alert triggered", "/operator/alerts"),
    "alert_escalated": ("Alert Escalated", "Alert auto-escalated to Maintenance Manager", "/operator/alerts"),
    "ticket_assigned": ("Ticket Updated", "Ticket status changed", "/maintenance/tickets"),
    "ticket_updated": ("Ticket Updated", "Ticket status changed", "/maintenance/tickets"),
    "ticket_closed": ("Ticket Updated", "Ticket status changed", "/maintenance/tickets"),
}


def to_event_json(df: DataFrame, kind: str | Column, time: str) -> DataFrame:
    """One JSON envelope ``{type, timestamp, payload}`` per row; times are ISO-8601 text."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    payload = [
        (iso_time(F.col(f.name)) if f.dataType.typeName().startswith("timestamp") else F.col(f.name)).alias(f.name)
        for f in df.schema.fields
    ]
    envelope = F.struct(kind.alias("type"), iso_time(F.col(time)).alias("timestamp"), F.struct(*payload).alias("payload"))
    return df.select(F.to_json(envelope, {"ignoreNullFields": "false"}).alias("value"))


def notices(events: DataFrame, kind: str, time: str, entity_id: str, message: str | None = None) -> DataFrame:
    """Notices for events of one kind; a message of the event replaces the standard text."""
    title, text, link = NOTICES[kind]
    shown = F.coalesce(F.col(message), F.lit(text)) if message else F.lit(text)
    return events.select(
        F.concat(F.lit(f"{kind}:"), F.col(entity_id).cast("string")).alias("notification_id"),
        F.lit(kind).alias("type"), F.lit(title).alias("title"), shown.alias("message"), F.lit(link).alias("link"),
        F.lit(False).alias("read"), F.col(entity_id).cast("string").alias("entity_id"), F.col(time).alias("timestamp"),
    )


def notices_by_kind(events: DataFrame, kinds: list[tuple[str, Column, str | None]], time: str, entity_id: str) -> DataFrame:
    """Notices of several kinds from one pass over the events: (kind, which rows, column of an own message)."""
    made = []
    for kind, rows, message in kinds:
        title, text, link = NOTICES[kind]
        shown = F.coalesce(F.col(message), F.lit(text)) if message else F.lit(text)
        made.append(F.when(rows, F.struct(
            F.lit(kind).alias("type"), F.lit(title).alias("title"), shown.alias("message"), F.lit(link).alias("link"),
        )))
    found = events.select(entity_id, time, F.explode(F.array_compact(F.array(*made))).alias("_n"))
    return found.select(
        F.concat(F.col("_n.type"), F.lit(":"), F.col(entity_id).cast("string")).alias("notification_id"),
        "_n.type", "_n.title", "_n.message", "_n.link", F.lit(False).alias("read"),
        F.col(entity_id).cast("string").alias("entity_id"), F.col(time).alias("timestamp"),
    )


def notification_feed(*kinds: DataFrame) -> DataFrame:
    """All notices in one shape; sort with ``feed_order``."""
    feed = kinds[0]
    for more in kinds[1:]:
        feed = feed.unionByName(more, allowMissingColumns=True)
    return feed


def feed_order() -> list[Column]:
    return [F.col("timestamp").desc(), F.col("notification_id").desc()]


def cascade_delete(tables: dict[str, DataFrame], machine_ids: DataFrame) -> dict[str, DataFrame]:
    """Every table with ``machine_id`` without the rows of the removed machines."""
    gone = machine_ids.select("machine_id").distinct()
    return {name: table.join(gone, "machine_id", "left_anti") for name, table in tables.items()}
