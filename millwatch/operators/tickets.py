"""Ticket listings, enrichment, work lists, repair figures and life cycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from millwatch.functions.numbers import MICROS_PER_HOUR, exact_mean, micros_between
from millwatch.operators.changes import SET, apply_changes, known_changes
from millwatch.schemas import FINISHED_TICKET

WORKING = ["assigned", "accepted", "in_progress", "paused"]


def open_tickets(tickets: DataFrame) -> DataFrame:
    """Tickets neither closed nor reviewed."""
    return tickets.filter(~F.col("status").isin(FINISHED_TICKET))


def with_open_ticket_count(machines: DataFrame, tickets: DataFrame) -> DataFrame:
    counts = open_tickets(tickets).groupBy("machine_id").agg(F.count("*").alias("open_tickets"))
    return machines.join(counts, "machine_id", "left").withColumn(
        "open_tickets", F.coalesce("open_tickets", F.lit(0))
    )


def machines_without_open_ticket(machines: DataFrame, tickets: DataFrame) -> DataFrame:
    busy = open_tickets(tickets).select("machine_id").distinct()
    return machines.join(busy, "machine_id", "left_anti")


def enrich_tickets(tickets: DataFrame, machines: DataFrame, users: DataFrame) -> DataFrame:
    """Tickets with the names of machine, operator and mechanic, null where unknown."""
    return (
        tickets.join(machines.select("machine_id", F.col("name").alias("machine_name")), "machine_id", "left")
        .join(users.select(F.col("user_id").alias("operator_id"), F.col("name").alias("operator_name")), "operator_id", "left")
        .join(users.select(F.col("user_id").alias("mechanic_id"), F.col("name").alias("mechanic_name")), "mechanic_id", "left")
    )


def ticket_order() -> list[Column]:
    """Sort order of ticket lists: newest first."""
    return [F.col("created_at").desc(), F.col("ticket_id").desc()]


def mechanic_worklist(tickets: DataFrame, shown: int = 5) -> DataFrame:
    """Per mechanic the newest ticket being worked on, and the newest completed ones."""
    status = F.col("status")
    kind = F.when(status.isin(WORKING), "active").when(status != "open", "completed")
    order = Window.partitionBy("mechanic_id", "kind").orderBy(*ticket_order())
    return (
        tickets.filter(F.col("mechanic_id").isNotNull()).withColumn("kind", kind).filter(F.col("kind").isNotNull())
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= shown)
        .filter((F.col("kind") == "completed") | (F.col("rank") == 1))
    )


def ticket_next_action(tickets: DataFrame) -> DataFrame:
    """What the manager can do with a ticket."""
    status = F.col("status")
    unassigned = (status == "open") | ((status == "assigned") & F.col("mechanic_id").isNull())
    return tickets.withColumn(
        "next_action",
        F.when(unassigned, "assign").when(status == "repaired", "review").when(status == "reviewed", "close").otherwise("none"),
    )


def task_detail(tickets: DataFrame, machines: DataFrame, latest_predictions: DataFrame) -> DataFrame:
    """Ticket with its machine and the latest prediction of that machine."""
    machine = machines.select(
        "machine_id", F.col("name").alias("machine_name"), F.col("location").alias("machine_location"),
        F.col("status").alias("machine_status"), F.col("health_score").alias("machine_health"),
    )
    prediction = latest_predictions.select(
        "machine_id", F.col("failure_type").alias("predicted_failure"),
        F.col("confidence").alias("prediction_confidence"), F.col("rul_hours").alias("predicted_rul_hours"),
    )
    return tickets.join(machine.join(prediction, "machine_id", "left"), "machine_id")


def mttr(tickets: DataFrame, by: str | None = None) -> DataFrame:
    """Mean repair hours of tickets that report them, and mean hours from opening to closing."""
    done = tickets.filter(F.col("time_taken_hours").isNotNull())
    groups = done.groupBy(by) if by else done.groupBy()
    open_micros = micros_between(F.col("created_at"), F.col("closed_at")).cast("decimal(38,0)")
    return groups.agg(
        F.count("*").alias("repaired_tickets"),
        exact_mean(F.col("time_taken_hours")).alias("mttr_hours"),
        (F.sum(open_micros).cast("double") / F.lit(MICROS_PER_HOUR) / F.count(open_micros)).alias("mean_hours_to_close"),
    )


def maintenance_kpis(tickets: DataFrame, mechanics: DataFrame) -> DataFrame:
    """Ticket and mechanic counts of the maintenance dashboard, one row."""
    status, login = F.col("status"), F.col("login_status")
    staff = mechanics.agg(F.struct(F.count_if(login == "available").alias("available"), F.count("*").alias("total"))).scalar()
    return (
        tickets.agg(
            F.count_if(status == "open").alias("open_tickets"),
            F.count_if(status.isin("assigned", "in_progress")).alias("in_progress"),
            F.count_if(status == "repaired").alias("to_review"),
        )
        .withColumn("_staff", staff)
        .select("open_tickets", "in_progress", "to_review", F.col("_staff.available").alias("available_mechanics"), F.col("_staff.total").alias("total_mechanics"))
    )


def update_tickets(tickets: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Partial ticket updates and the rows they leave behind.

    ``changes(ticket_id, seq, _set, changed_by, changed_at, ...ticket columns)``. A change to
    ``reviewed`` that states a cost gives a cost row, each change of a known ticket an audit row; a
    change to ``closed`` stamps the time. Gives (tickets, cost rows, audit rows).
    """
    values = [c for c in changes.columns if c in tickets.columns and c != "ticket_id"]
    set_to = lambda column, word: F.array_contains(SET, column) & (F.col(column) == word)
    closing = set_to("status", "closed")
    stamped = changes.withColumn("closed_at", F.when(closing, F.col("changed_at")).cast(tickets.schema["closed_at"].dataType))
    stamped = stamped.withColumn(SET, F.when(closing, F.array_union(SET, F.array(F.lit("closed_at")))).otherwise(F.col(SET)))
    known = known_changes(changes, tickets.select("ticket_id", F.col("machine_id").alias("_machine")), "ticket_id")
    cost_rows = known.filter(
        set_to("status", "reviewed") & F.array_contains(SET, "repair_cost") & F.col("repair_cost").isNotNull()
    ).select(
        _row_id("ticket_id", "seq", "cost").alias("cost_id"), "ticket_id", F.col("_machine").alias("machine_id"),
        F.col("repair_cost").cast("decimal(18,2)").alias("amount"),
        F.month("changed_at").alias("month"), F.year("changed_at").alias("year"),
        F.col("changed_by").alias("approved_by"), F.col("changed_at").alias("created_at"),
    )
    fields = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in values])
    written = F.map_from_entries(F.filter(fields, lambda f: F.array_contains(SET, f["key"])))
    audit_rows = known.select(
        _row_id("ticket_id", "seq", "audit").alias("log_id"), F.col("changed_by").alias("user_id"),
        F.lit("UPDATE_TICKET").alias("action"), F.lit("ticket").alias("entity_type"),
        F.col("ticket_id").alias("entity_id"), F.lit(None).cast("string").alias("old_value"),
        F.to_json(written, {"ignoreNullFields": "false"}).alias("new_value"),
        F.col("changed_at").alias("timestamp"), F.lit("127.0.0.1").alias("ip_address"),
    )
    return apply_changes(tickets, stamped, "ticket_id"), cost_rows, audit_rows


def _row_id(key: str, seq: str, kind: str) -> Column:
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.col(seq).cast("string"), F.lit(kind)))


# The status each step of the life cycle leads to, and the columns it sets.
TRANSITIONS = {
    "assign": ("assigned", ["mechanic_id", "manager_id"]),
    "accept": ("accepted", []),
    "reject": ("open", ["mechanic_id"]),
    "start": ("in_progress", []),
    "pause": ("paused", []),
    "resume": ("in_progress", []),
    "report": ("repaired", ["repair_report", "parts_used", "time_taken_hours"]),
    "review": ("reviewed", ["repair_cost"]),
    "close": ("closed", []),
}
# Steps after which the mechanic is free again.
RELEASING = ["reject", "report"]


def transition_changes(actions: DataFrame) -> DataFrame:
    """Ticket changes of ``actions(ticket_id, seq, action, mechanic_id, changed_by, changed_at, ...)``;
    unknown words are dropped."""
    action = F.col("action")
    status, columns = F, F
    for word, (target, extra) in TRANSITIONS.items():
        status = status.when(action == word, target)
        columns = columns.when(action == word, F.array(*[F.lit(c) for c in ["status", *extra]]))
    return (
        actions.filter(action.isin(list(TRANSITIONS)))
        .withColumns({"status": status, SET: columns})
        .withColumn("mechanic_id", F.when(action != "reject", F.col("mechanic_id")))
    )


def mechanic_changes(actions: DataFrame) -> DataFrame:
    """What the steps mean for mechanics: busy on assignment, available when released."""
    action = F.col("action")
    return actions.filter(action.isin("assign", *RELEASING)).select(
        "mechanic_id", "seq",
        F.when(action == "assign", "busy").otherwise("available").alias("login_status"),
        F.when(action == "assign", F.col("ticket_id")).alias("current_assignment_id"),
        F.array(F.lit("login_status"), F.lit("current_assignment_id")).alias(SET),
    )


def ticket_transitions(tickets: DataFrame, mechanics: DataFrame, actions: DataFrame) -> dict[str, DataFrame]:
    """Run life-cycle steps in order of ``seq``: tickets, mechanics, cost and audit rows after them.

    The releasing steps name the mechanic who acts in ``mechanic_id``.
    """
    updated, cost_rows, audit_rows = update_tickets(tickets, transition_changes(actions))
    staff = mechanic_changes(actions)
    known = known_changes(staff, mechanics.select("mechanic_id"), "mechanic_id")
    return {
        "tickets": updated,
        "mechanics": apply_changes(mechanics, known, "mechanic_id"),
        "cost_rows": cost_rows,
        "audit_rows": audit_rows,
    }
