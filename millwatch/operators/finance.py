"""Maintenance cost by period and machine, factory statistics and owner figures.

``cost`` may hold cost rows or sums of them by year, month and machine (``streaming.spending``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millwatch.functions.health import uptime
from millwatch.functions.numbers import exact_mean, exact_sum, round_to
from millwatch.functions.texts import month_period
from millwatch.operators.tickets import open_tickets

# Share of cost counted as saved, and health to efficiency.
SAVED_SHARE = 0.45
EFFICIENCY = 0.95


#: Column of a table of sums that tells how many cost rows a row stands for.
ROWS = "cost_rows"


def row_count(cost: DataFrame) -> Column:
    """Number of cost rows, also where ``cost`` holds sums of them."""
    return F.sum(ROWS) if ROWS in cost.columns else F.count("*")


def _grain(grain: str) -> list[str]:
    return ["year"] if grain == "year" else ["year", "month"]


def _period(grain: str) -> Column:
    """``YYYY`` or ``YYYY-MM``, made after grouping by numbers."""
    return F.col("year").cast("string") if grain == "year" else month_period(F.col("year"), F.col("month"))


def expenses(cost: DataFrame, grain: str = "month") -> DataFrame:
    """Cost and number of cost rows per period; sort by ``period`` to show."""
    sums = cost.groupBy(*_grain(grain)).agg(F.sum("amount").alias("total_cost"), row_count(cost).alias("ticket_count"))
    return sums.select(_period(grain).alias("period"), "total_cost", "ticket_count")


def expenses_all_grains(cost: DataFrame) -> DataFrame:
    """Both grains in one pass over the data; only the months' sums are rolled up."""
    months = cost.groupBy("year", "month").agg(F.sum("amount").alias("total_cost"), row_count(cost).alias("ticket_count"))
    rolled = months.rollup("year", "month").agg(
        F.sum("total_cost").cast(months.schema["total_cost"].dataType).alias("total_cost"),
        F.sum("ticket_count").alias("ticket_count"), F.grouping_id().alias("_grain"),
    )
    yearly = F.col("_grain") == 1
    return rolled.filter(F.col("_grain") < 3).select(
        F.when(yearly, "year").otherwise("month").alias("grain"),
        F.when(yearly, F.col("year").cast("string")).otherwise(month_period(F.col("year"), F.col("month"))).alias("period"),
        "total_cost", "ticket_count",
    )


def expense_breakdown(cost: DataFrame, machines: DataFrame, grain: str = "month") -> DataFrame:
    """Cost per period and machine beside the total of the period.

    One row per machine rather than a list in the period row, which would have no bound. Periods
    are summed from the machine rows, so the data is read and shuffled once; there are at most
    twelve of them a year, which is why they are broadcast.
    """
    keys = _grain(grain)
    parts = cost.groupBy(*keys, "machine_id").agg(F.sum("amount").alias("total_cost"), row_count(cost).alias("ticket_count"))
    totals = parts.groupBy(*keys).agg(
        F.sum("total_cost").alias("period_cost"), F.sum("ticket_count").alias("period_tickets")
    )
    names = machines.select("machine_id", F.col("name").alias("machine_name"))
    return parts.join(names, "machine_id", "left").join(F.broadcast(totals), keys).select(
        _period(grain).alias("period"), "machine_id", F.coalesce("machine_name", F.lit("Unknown")).alias("machine_name"),
        "total_cost", "ticket_count", "period_cost", "period_tickets",
    )


def avg_repair_time(tickets: DataFrame, cost: DataFrame, grain: str = "month") -> DataFrame:
    """Mean repair hours over the tickets that have cost in a period, each ticket counted once."""
    keys = _grain(grain)
    billed = cost.select(*keys, "ticket_id").distinct()
    hours = tickets.select("ticket_id", "time_taken_hours").filter(F.col("time_taken_hours").isNotNull())
    means = billed.join(hours, "ticket_id").groupBy(*keys).agg(
        F.count("*").alias("repaired_tickets"), exact_mean(F.col("time_taken_hours")).alias("avg_repair_time")
    )
    return means.select(_period(grain).alias("period"), "repaired_tickets", "avg_repair_time")


def merge_repair_times(parts: DataFrame, period: str = "period") -> DataFrame:
    """Yearly mean from monthly rows, weighted by their tickets."""
    weighted = exact_sum(F.col("avg_repair_time") * F.col("repaired_tickets"))
    return parts.groupBy(F.substring(period, 1, 4).alias("period")).agg(
        F.sum("repaired_tickets").alias("repaired_tickets"),
        (weighted / F.sum("repaired_tickets")).alias("avg_repair_time"),
    )


def factory_stats(machines: DataFrame, alerts: DataFrame, tickets: DataFrame, cost: DataFrame, as_of: str) -> DataFrame:
    """Factory figures in one row; every table is aggregated on its own."""
    status = F.col("status")
    health = F.coalesce(exact_mean(F.col("health_score")), F.lit(0.0))
    year = int(as_of[:4])
    money = F.struct(
        F.coalesce(F.sum("amount"), F.lit(0)).cast("decimal(28,2)").alias("total"),
        F.coalesce(F.sum(F.when(F.col("year") == year, F.col("amount"))), F.lit(0)).cast("decimal(28,2)").alias("ytd"),
    )
    return (
        machines.agg(
            F.count("*").alias("total_machines"),
            F.count_if(status == "normal").alias("machines_operational"),
            F.count_if(status == "warning").alias("machines_warning"),
            F.count_if(status == "critical").alias("machines_critical"),
            round_to(health, 1).alias("avg_health_score"),
            uptime(health).alias("overall_uptime_percent"),
        )
        .withColumn("total_alerts", alerts.agg(F.count("*")).scalar())
        .withColumn("open_tickets", open_tickets(tickets).agg(F.count("*")).scalar())
        .withColumn("_money", cost.agg(money).scalar())
        .select("*", F.col("_money.total").alias("total_cost"), F.col("_money.ytd").alias("cost_ytd"))
        .drop("_money")
    )


def owner_kpis(cost: DataFrame, machines: DataFrame) -> DataFrame:
    """Latest month and year of cost, savings and return, efficiency by mean health; one row."""
    months = cost.groupBy("year", "month").agg(F.sum("amount").alias("_cost"))
    latest = (
        months.groupBy("year")
        .agg(F.sum("_cost").alias("_year_cost"), F.max_by("_cost", "month").alias("_month_cost"), F.max("month").alias("_month"))
        .agg(
            F.max_by("_month_cost", "year").alias("_m"), F.max_by("_year_cost", "year").alias("_y"),
            F.max_by(month_period(F.col("year"), F.col("_month")), "year").alias("current_period"),
        )
    )
    year_cost = F.coalesce(F.col("_y").cast("double"), F.lit(0.0))
    savings = F.col("current_year_cost") * SAVED_SHARE
    divisor = F.when(F.col("current_year_cost") == 0, 1.0).otherwise(F.col("current_year_cost"))
    health = machines.agg(round_to(F.coalesce(exact_mean(F.col("health_score")), F.lit(0.0)), 1)).scalar()
    return (
        latest.select(
            "current_period", F.coalesce(F.col("_m").cast("double"), F.lit(0.0)).alias("current_month_cost"),
            year_cost.alias("current_year_cost"),
        )
        .withColumns({"estimated_savings": savings, "_health": health})
        .withColumn("roi_percent", round_to(F.col("estimated_savings") / divisor * 100.0, 1))
        .withColumn("efficiency_score", round_to(F.col("_health") * EFFICIENCY, 1))
        .withColumn("improvement_opportunity", 100.0 - F.col("efficiency_score"))
        .drop("_health")
    )


def expense_trend(cost: DataFrame, n: int = 12, grain: str = "month") -> DataFrame:
    """The last n periods, oldest first."""
    last = expenses(cost, grain).orderBy(F.col("period").desc()).limit(n)
    return last.orderBy("period")
