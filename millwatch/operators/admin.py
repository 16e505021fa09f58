"""Users, mechanics, audit trail and notifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millwatch.functions.texts import json_variant
from millwatch.operators import trigrams
from millwatch.operators.changes import SET, apply_changes, with_set_mask
from millwatch.operators.validate import insert_if_absent


def search_users(users: DataFrame, text: str = "", role: str | None = None) -> DataFrame:
    """Users whose name or e-mail holds the text in any case, and who have the role."""
    found = users
    if text:
        needle = text.lower()
        found = found.filter(F.lower("name").contains(needle) | F.lower("email").contains(needle))
    return found.filter(F.col("role") == role) if role and role != "all" else found


def search_users_indexed(users: DataFrame, index: str, text: str, role: str | None = None) -> DataFrame:
    """The same by the trigram index of names and e-mails (``trigrams.index_texts``): only candidates are read from the users and
    tested. A text of one or two letters has no trigram and is searched for as before."""
    keys = trigrams.candidates(users.sparkSession, index, text)
    if keys is None:
        return search_users(users, text, role)
    return search_users(users.join(keys.withColumnRenamed("key", "user_id"), "user_id", "left_semi"), text, role)


def available_mechanics(mechanics: DataFrame) -> DataFrame:
    return mechanics.filter(F.col("login_status") == "available")


def mechanic_directory(mechanics: DataFrame, users: DataFrame) -> DataFrame:
    people = users.select(F.col("user_id").alias("mechanic_id"), "name", "email")
    return mechanics.join(people, "mechanic_id")


def audit_trail(audit: DataFrame, users: DataFrame) -> DataFrame:
    """Audit rows with the user's name; page them with ``audit_order``."""
    names = users.select("user_id", F.col("name").alias("user_name"))
    return audit.join(names, "user_id", "left").withColumn("user_name", F.coalesce("user_name", F.lit("System")))


def audit_values(audit: DataFrame) -> DataFrame:
    """Audit rows with their values as VARIANT, to be stored so: a reader takes a field without parsing text again."""
    return audit.withColumns({c: json_variant(F.col(c)) for c in ("old_value", "new_value")})


def audit_order() -> list[Column]:
    return [F.col("timestamp").desc(), F.col("log_id").desc()]


def user_kpis(users: DataFrame) -> DataFrame:
    return users.agg(F.count("*").alias("total_users"), F.count_if("is_active").alias("active_users"))


def unread_counts(notifications: DataFrame) -> DataFrame:
    return notifications.groupBy("user_id").agg(F.count_if(~F.col("read")).alias("unread"))


def mark_read(notifications: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Mark the given notifications read, or all."""
    if ids is None:
        return notifications.withColumn("read", F.lit(True))
    chosen = ids.select("notification_id").distinct().withColumn("_chosen", F.lit(True))
    return (
        notifications.join(chosen, "notification_id", "left")
        .withColumn("read", F.col("read") | F.coalesce("_chosen", F.lit(False)))
        .drop("_chosen")
    )


def update_mechanics(mechanics: DataFrame, changes: DataFrame) -> DataFrame:
    """Status and assignment updates; with a ``_set`` column an assignment can be cleared, without one
    a null means "leave as is"."""
    if SET not in changes.columns:
        changes = with_set_mask(changes, ["login_status", "current_assignment_id"])
    return apply_changes(mechanics, changes, "mechanic_id")


def deactivate_users(users: DataFrame, ids: DataFrame) -> DataFrame:
    """Soft delete."""
    gone = ids.select("user_id").distinct().withColumn("_gone", F.lit(True))
    return (
        users.join(gone, "user_id", "left")
        .withColumn("is_active", F.col("is_active") & F.col("_gone").isNull())
        .drop("_gone")
    )


def create_users(users: DataFrame, mechanics: DataFrame, incoming: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Add users whose e-mail is new; mechanics get a profile. Gives (users, mechanics, rejected)."""
    added, rejected = insert_if_absent(users, incoming, "email", order)
    profiles = added.filter(F.col("role") == "mechanic").select(
        F.col("user_id").alias("mechanic_id"), F.lit("offline").alias("login_status")
    )
    return (
        users.unionByName(added.select(*users.columns)),
        mechanics.unionByName(profiles, allowMissingColumns=True),
        rejected.withColumn("reason", F.lit("Email already registered")),
    )
