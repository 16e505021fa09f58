"""Row scoping by role."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def active_users(users: DataFrame) -> DataFrame:
    return users.filter(F.col("is_active"))


def visible_machines(machines: DataFrame, user_id, role: str) -> DataFrame:
    """An operator sees the assigned machines, every other role all."""
    if role != "operator":
        return machines
    return machines.filter(F.col("assigned_operator_id") == user_id)


def machines_by_operator(machines: DataFrame, users: DataFrame) -> DataFrame:
    """The scope of every operator at once: (user, machine) pairs along the assignment."""
    operators = active_users(users).filter(F.col("role") == "operator").select(
        F.col("user_id").alias("assigned_operator_id"), F.col("name").alias("operator_name")
    )
    return machines.join(operators, "assigned_operator_id")


def visible_tickets(tickets: DataFrame, user_id, role: str, status: str | None = None) -> DataFrame:
    """An operator sees own tickets, a mechanic the assigned ones, every other role all."""
    shown = tickets
    if role == "operator":
        shown = shown.filter(F.col("operator_id") == user_id)
    elif role == "mechanic":
        shown = shown.filter(F.col("mechanic_id") == user_id)
    return shown.filter(F.col("status") == status) if status else shown


def tickets_by_user(tickets: DataFrame, users: DataFrame) -> DataFrame:
    """The scope of every operator and mechanic at once, one row per user and ticket."""
    columns = list(tickets.columns)
    shares = F.array(
        F.struct(F.col("operator_id").alias("user_id"), F.lit("operator").alias("role")),
        F.struct(F.col("mechanic_id").alias("user_id"), F.lit("mechanic").alias("role")),
    )
    people = active_users(users).select("user_id", "role", F.col("name").alias("user_name"))
    return tickets.select(*columns, F.inline(shares)).join(people, ["user_id", "role"])


def lookup(df: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows for the asked keys, and the keys that have none."""
    asked = keys.select(key).distinct()
    known = df.select(key).distinct()
    return df.join(asked, key, "left_semi"), asked.join(known, key, "left_anti")
