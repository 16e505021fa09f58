"""What the physical plans must and must not hold, with broadcasting by size switched off."""

import pytest

import __spark_entry__ as contract
from conftest import SF

WRITES_FIRST = ("s2_", "s8_", "t1_alarm_stream", "t2_score_stream", "t3_escalation_stream", "t4_dedupe_stream", "t5_", "t6_", "t3_late", "t4_late")
LAZY = [name for name in contract.queries() if not name.startswith(WRITES_FIRST) and not name.endswith("_kept")]


@pytest.fixture(scope="module")
def plans(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    queries = contract.queries()
    yield {n: queries[n](spark, SF)._jdf.queryExecution().executedPlan().toString() for n in LAZY}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_no_cross_joins_and_no_row_python(plans):
    for name, plan in plans.items():
        for word in ("CartesianProduct", "NestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
            assert word not in plan, (name, word)


def test_single_partition_only_for_one_row_results(plans):
    one_row = {"a4", "a7", "a9", "a10", "a11", "a13", "a14", "a15", "a16", "l2", "u2"}
    for name, plan in plans.items():
        if "SinglePartition" in plan:
            assert name.split("_")[0] in one_row, name


def test_top_k_per_group_is_cut_before_the_shuffle(plans):
    for name in ("w3_latest_per_machine", "w4_trend_series", "p9_mechanic_worklist", "j10_machine_detail"):
        assert "WindowGroupLimit" in plans[name] and ", Partial" in plans[name], name


def test_newest_and_last_write_merge_before_the_shuffle(plans):
    for name in ("t2_score_fleet", "j11_fleet_snapshot"):
        assert "partial_max_by" in plans[name], name
    assert "partial_max_by" in plans["m1_apply_changes"]


def test_pages_are_top_k(plans):
    for name in ("l1_page_offset", "l1_page_after", "l2_paginate", "l3_newest_alerts", "w1_recent_readings", "j4_audit_page"):
        assert "TakeOrderedAndProject" in plans[name], name
        assert "rangepartitioning" not in plans[name], name


def test_scalar_functions_need_no_shuffle(plans):
    for name in ("f1_health_score", "f5_failure_type", "f9_sensor_band", "f10_gauge_percent", "x1_sql_functions", "s9_event_json", "s3_valid"):
        assert "Exchange" not in plans[name], name


def test_only_chosen_predictions_travel(spark):
    """The filter of chosen ids stands before the shuffle of the predictions, and lets few others pass."""
    from pyspark.sql import functions as F

    from millwatch.operators import alerts, bitfilter

    predictions = spark.range(200_000).selectExpr("id AS prediction_id", "id % 50 AS machine_id", "timestamp_micros(id * 1000000) AS timestamp", "repeat('x', 20) AS text")
    asked = spark.range(300).selectExpr("id AS alert_id", "id % 50 AS machine_id", "timestamp_micros(id * 600000000 + 5) AS triggered_at")
    plan = alerts.alerts_with_prediction(asked, predictions)._jdf.queryExecution().optimizedPlan().toString()
    assert "bitmap_construct_agg" in plan and "strategy=broadcast" in plan
    chosen = predictions.filter("prediction_id % 1000 = 7").select(F.col("prediction_id").alias("_id"))
    passed = bitfilter.may_hold(predictions, "prediction_id", bitfilter.bitmaps(chosen, "_id"))
    assert passed.filter("prediction_id % 1000 = 7").count() == 200 and passed.count() < 400


def test_columns_are_pruned_and_filters_pushed(plans):
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_shipdate:timestamp_ntz>" in plans["a1_expenses_month"]
    assert "EqualTo(user_id,7)" in plans["w1_recent_readings"]


def test_moves_are_not_sent_through_the_driver(spark, monkeypatch):
    from millwatch.operators import production

    plans, store = [], production.stored
    monkeypatch.setattr(production, "stored", lambda df, label: plans.append(df) or store(df, label))
    machines = spark.createDataFrame([(i, f"m{i}", "normal") for i in range(4)], "machine_id long, name string, status string")
    moves = spark.createDataFrame([(i, i, i % 4, (i + 1) % 4, 1, None) for i in range(9)], "move_id long, seq long, source long, target long, user_id long, moved_at timestamp_ntz")
    schedules = spark.createDataFrame([(1, 0, "halted", "x"), (2, 7, "halted", "y")], "schedule_id long, machine_id long, status string, delay_reason string")
    out = production.reallocate(machines, schedules, None, moves)["schedules"]
    joins = [p for p in (df._jdf.queryExecution().executedPlan().toString() for df in [*plans, out]) if "Join" in p]
    assert len(joins) >= 3 and not [p for p in joins if "Broadcast" in p]
    assert sorted(map(tuple, out.collect())) == [(1, 1, "on_track", "Reallocated from m0"), (2, 7, "halted", "y")]
