"""Production schedules and the reallocation of load."""

from __future__ import annotations

from collections.abc import Mapping
from functools import cached_property

from pyspark.sql import DataFrame, Window, functions as F

from millwatch.operators.changes import SET, apply_changes
from millwatch.operators.tickets import open_tickets
from millwatch.session import stored


def schedules_with_machine(schedules: DataFrame, machines: DataFrame) -> DataFrame:
    names = machines.select("machine_id", F.col("name").alias("machine_name"))
    return schedules.join(names, "machine_id", "left").withColumn(
        "machine_name", F.coalesce("machine_name", F.lit("Unknown"))
    )


def update_schedules(schedules: DataFrame, changes: DataFrame) -> DataFrame:
    """Set the status from ``changes(schedule_id, seq, status, delay_reason)``; without a reason the
    old one stays."""
    stated = F.when(F.col("delay_reason").isNull(), F.array(F.lit("status"))).otherwise(
        F.array(F.lit("status"), F.lit("delay_reason"))
    )
    return apply_changes(schedules, changes.withColumn(SET, stated), "schedule_id")


def _named(moves: DataFrame, machines: DataFrame) -> DataFrame:
    """Moves with the names of both machines, null where a machine is unknown. Machines are shuffled, not sent through the driver."""
    names = machines.select("machine_id", "name").hint("merge")
    return (
        moves.join(names.select(F.col("machine_id").alias("source"), F.col("name").alias("source_name")), "source", "left")
        .join(names.select(F.col("machine_id").alias("target"), F.col("name").alias("target_name")), "target", "left")
    )


def _last_of_chain(moves: DataFrame) -> DataFrame:
    """seq of every move, and as ``last`` the move that its load makes last.

    Load that a move brings to its target goes on with the first later move whose source is that target. These links are
    joined with themselves, so that their length doubles, until none gets longer; each round is written to the shared folder.
    All sides grow with the moves and are shuffled: a broadcast would send them through the driver, two of them every round.
    """
    leaves = moves.select(F.col("source").alias("machine"), "seq", F.lit(0).alias("side"), F.col("seq").alias("leave"))
    arrives = moves.select(F.col("target").alias("machine"), "seq", F.lit(1), F.lit(None).cast(moves.schema["seq"].dataType))
    later = Window.partitionBy("machine").orderBy("seq", "side").rowsBetween(1, Window.unboundedFollowing)
    linked = leaves.union(arrives).withColumn("next", F.first("leave", ignorenulls=True).over(later)).filter("side = 1")
    links = linked.select("seq", F.coalesce("next", "seq").alias("end"))
    while True:
        links = stored(links, "move-links")
        first, second = (links.select(F.col("seq").alias(a), F.col("end").alias(b)).hint("merge") for a, b in (("end", "_end"), ("_end", "_far")))
        longer = stored(links.join(first, "end").join(second, "_end").select("seq", F.col("_far").alias("end"), (F.col("_far") != F.col("end")).alias("grew")), "move-links")
        links = longer.select("seq", "end")
        if longer.filter("grew").isEmpty():
            break
    ends = moves.select(F.col("seq").alias("end"), F.struct("target", "source_name").alias("last")).hint("merge")
    return links.join(ends, "end").select("seq", "last")


# The texts that a move leaves behind.
DELAY_REASON = "Reallocated from "
TICKET_TEXT = ("Auto-generated: Machine load reallocated to ", ". Maintenance required.")
AUDIT_TEXT = ("Production reallocated from ", " to ")
NOTICE_TITLE, NOTICE_TEXT = "Load Reallocated", ("Production shifted from ", " to ", ".")
UNKNOWN_MACHINE = "Machine not found"


class Reallocation(Mapping):
    """The results of a batch of moves by name, each built when it is asked for: only ``schedules`` follows chains of moves."""

    PARTS = ("machines", "schedules", "tickets", "audit_rows", "notifications", "rejected")

    def __init__(self, machines: DataFrame, schedules: DataFrame, tickets: DataFrame, moves: DataFrame):
        self._machines, self._schedules, self._tickets = machines, schedules, tickets
        resolved = _named(moves, machines)
        known = F.col("source_name").isNotNull() & F.col("target_name").isNotNull()
        self._valid, self._unknown = resolved.filter(known), resolved.filter(~known)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.PARTS:
            raise KeyError(name)
        return getattr(self, name)

    def __iter__(self):
        return iter(self.PARTS)

    def __len__(self) -> int:
        return len(self.PARTS)

    def _first(self) -> DataFrame:
        """machine_id and its first move as a source."""
        return self._valid.groupBy("source").agg(
            F.min_by(F.struct("seq", "target", "source_name", "target_name", "user_id", "moved_at"), "seq").alias("_move")
        ).select(F.col("source").alias("machine_id"), "_move")

    @cached_property
    def machines(self) -> DataFrame:
        moved = F.col("_move").isNotNull()
        return (
            self._machines.join(self._first(), "machine_id", "left")
            .withColumn("status", F.when(moved, "maintenance").otherwise(F.col("status"))).drop("_move")
        )

    @cached_property
    def schedules(self) -> DataFrame:
        valid = stored(self._valid, "moves")
        first = valid.groupBy(F.col("source").alias("machine_id")).agg(F.min("seq").alias("seq"))
        last = first.join(_last_of_chain(valid).hint("merge"), "seq").select("machine_id", F.col("last").alias("_move")).hint("merge")
        moved = F.col("_move").isNotNull()
        changed = {
            "machine_id": F.when(moved, F.col("_move.target")).otherwise(F.col("machine_id")),
            "status": F.when(moved, "on_track").otherwise(F.col("status")),
            "delay_reason": F.when(moved, F.concat(F.lit(DELAY_REASON), F.col("_move.source_name"))).otherwise(F.col("delay_reason")),
        }
        return self._schedules.join(last, "machine_id", "left").withColumns(changed).select(*self._schedules.columns)

    @cached_property
    def tickets(self) -> DataFrame:
        busy = open_tickets(self._tickets).select("machine_id").distinct()
        before, after = map(F.lit, TICKET_TEXT)
        return self._first().join(busy, "machine_id", "left_anti").select(
            F.md5(F.concat_ws("|", F.col("machine_id").cast("string"), F.lit("reallocation"), F.date_format("_move.moved_at", "yyyyMMddHHmmss"))).alias("ticket_id"),
            "machine_id", F.col("_move.user_id").alias("operator_id"), F.lit("open").alias("status"),
            F.concat(before, F.col("_move.target_name"), after).alias("description"),
            F.lit(False).alias("escalated"), F.col("_move.moved_at").alias("created_at"),
        )

    def _id(self, kind: str):
        return F.md5(F.concat_ws("|", F.col("move_id").cast("string"), F.lit(kind)))

    @cached_property
    def audit_rows(self) -> DataFrame:
        before, between = map(F.lit, AUDIT_TEXT)
        return self._valid.select(
            self._id("audit").alias("log_id"), "user_id", F.lit("REALLOCATE_LOAD").alias("action"), F.lit("Production").alias("entity_type"),
            F.col("source").alias("entity_id"), F.concat(before, F.col("source_name"), between, F.col("target_name")).alias("new_value"),
            F.col("moved_at").alias("timestamp"), F.lit("127.0.0.1").alias("ip_address"),
        )

    @cached_property
    def notifications(self) -> DataFrame:
        before, between, after = map(F.lit, NOTICE_TEXT)
        return self._valid.select(
            self._id("notice").alias("notification_id"), "user_id", F.lit(NOTICE_TITLE).alias("title"),
            F.concat(before, F.col("source_name"), between, F.col("target_name"), after).alias("message"),
            F.lit(False).alias("read"), F.col("moved_at").alias("created_at"),
        )

    @cached_property
    def rejected(self) -> DataFrame:
        return self._unknown.select("move_id", "source", "target", F.lit(UNKNOWN_MACHINE).alias("reason"))


def reallocate(machines: DataFrame, schedules: DataFrame, tickets: DataFrame, moves: DataFrame) -> Reallocation:
    """Move load off machines: ``moves(move_id, seq, source, target, user_id, moved_at)``, in the order of ``seq``.

    Moves with an unknown machine are rejected. A source goes into maintenance; the schedules that are on it at that
    moment follow and are on track again, so one may be moved several times; a source without an open ticket gets one; each
    move leaves an audit row and a notice.
    """
    return Reallocation(machines, schedules, tickets, moves)
