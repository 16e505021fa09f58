"""The star-schema test tables seen as a machine fleet.

customer gives machines, supplier gives users and mechanics, events gives sensor readings and audit
rows, hot readings give alerts, orders gives tickets, lineitem with orders gives cost rows, part
gives production schedules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millwatch.operators.scoring import score_readings

# Columns as stored; readers prune to what a query uses.
STORED = {
    "nation": "n_nationkey INT, n_name STRING",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": """o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE,
        o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING""",
    "lineitem": """l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT,
        l_extendedprice DOUBLE, l_shipdate TIMESTAMP_NTZ""",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}

TICKET_STATUS = """CASE o_orderkey % 8 WHEN 0 THEN 'open' WHEN 1 THEN 'assigned' WHEN 2 THEN 'accepted'
    WHEN 3 THEN 'in_progress' WHEN 4 THEN 'paused' WHEN 5 THEN 'repaired' WHEN 6 THEN 'reviewed'
    ELSE 'closed' END"""

READING_COLUMNS = [
    "event_id AS reading_id", "user_id AS machine_id", "ts AS timestamp",
    "40 + value * 0.2D AS temperature",
    "0.2D + CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) * 0.05D AS vibration",
    "2 + (event_id % 113) / 10.0D AS pressure",
    "10 + (event_id % 131) / 10.0D AS current",
    "CAST(1500 + (event_id * 7) % 2200 AS DOUBLE) AS rpm",
    "CAST(55 + (event_id % 45) AS DOUBLE) AS noise_level",
]


COST_COLUMNS = [
    "l_orderkey AS ticket_id", "l_linenumber AS line_no", "o_custkey AS machine_id",
    "CAST(l_extendedprice AS DECIMAL(18,2)) AS amount",
    "month(l_shipdate) AS month", "year(l_shipdate) AS year", "l_suppkey AS approved_by",
]


class Demo:
    """Entity tables of one scale-factor folder, each a lazy frame."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def stored(self, name: str) -> DataFrame:
        return self.spark.read.schema(STORED[name]).parquet(f"{self.folder}/{name}.parquet")

    def users(self) -> DataFrame:
        return self.stored("supplier").selectExpr(
            "s_suppkey AS user_id", "s_name AS name",
            "lower(replace(s_name, '#', '.')) || '@example.com' AS email",
            """CASE s_suppkey % 6 WHEN 0 THEN 'operator' WHEN 1 THEN 'mechanic'
               WHEN 2 THEN 'maintenance_manager' WHEN 3 THEN 'production_manager'
               WHEN 4 THEN 'factory_owner' ELSE 'admin' END AS role""",
            "s_suppkey % 10 <> 3 AS is_active",
        )

    def mechanics(self) -> DataFrame:
        return self.stored("supplier").filter("s_suppkey % 6 = 1").selectExpr(
            "s_suppkey AS mechanic_id",
            """CASE s_nationkey % 2 WHEN 0 THEN 'Electrical & Mechanical'
               ELSE 'Hydraulics & Pneumatics' END AS skill_type""",
            """CASE s_nationkey % 3 WHEN 0 THEN 'available' WHEN 1 THEN 'busy'
               ELSE 'offline' END AS login_status""",
            "CASE WHEN s_nationkey % 3 = 1 THEN s_suppkey END AS current_assignment_id",
            "CASE s_nationkey % 2 WHEN 0 THEN 'Morning' ELSE 'Evening' END AS shift",
        )

    def machines(self) -> DataFrame:
        customer, nation = self.stored("customer"), self.stored("nation")
        return (
            customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left")
            .selectExpr(
                "c_custkey AS machine_id", "c_name AS name", "n_name AS location", "c_mktsegment AS type",
                "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST((c_nationkey % 4) * 6 AS BIGINT) END AS assigned_operator_id",
                "floor(greatest(0D, least(100D, (c_acctbal + 1000) / 110)) * 10 + 0.5D) / 10 AS health_score",
            )
            .selectExpr(
                "*",
                """CASE WHEN health_score < 30 THEN 'critical' WHEN health_score < 60 THEN 'high'
                   WHEN health_score < 80 THEN 'medium' ELSE 'low' END AS risk_level""",
                "floor(health_score * 20 * 10 + 0.5D) / 10 AS rul_hours",
                """CASE WHEN machine_id % 13 = 0 THEN 'offline' WHEN machine_id % 17 = 5 THEN 'maintenance'
                   WHEN health_score < 30 THEN 'critical' WHEN health_score < 80 THEN 'warning'
                   ELSE 'normal' END AS status""",
            )
        )

    def readings(self) -> DataFrame:
        return self.stored("events").selectExpr(*READING_COLUMNS)

    def predictions(self) -> DataFrame:
        return score_readings(self.readings())

    def alerts(self) -> DataFrame:
        return self.readings().filter("temperature > 60").selectExpr(
            "reading_id AS alert_id", "machine_id", "timestamp AS triggered_at",
            """CASE WHEN temperature > 100 THEN 'critical' WHEN temperature > 85 THEN 'high'
               WHEN temperature > 70 THEN 'medium' ELSE 'low' END AS severity""",
            """CASE reading_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'acknowledged'
               WHEN 2 THEN 'escalated' ELSE 'resolved' END AS status""",
            """CASE WHEN reading_id % 4 = 1 THEN CASE WHEN reading_id % 8 = 1 THEN 'reported'
               ELSE 'ignored' END END AS operator_response""",
        )

    def tickets(self) -> DataFrame:
        return (
            self.stored("orders").withColumn("status", F.expr(TICKET_STATUS))
            .selectExpr(
                "o_orderkey AS ticket_id", "o_custkey AS machine_id", "(o_orderkey % 25) * 6 AS operator_id",
                "status",
                "CASE WHEN status = 'open' THEN NULL ELSE (o_orderkey % 20) * 6 + 1 END AS mechanic_id",
                "o_orderpriority AS description", "o_orderpriority = '1-URGENT' AS escalated",
                "o_orderdate AS created_at",
                "CASE WHEN status IN ('reviewed', 'closed') THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS repair_cost",
                """CASE WHEN status IN ('repaired', 'reviewed', 'closed')
                   THEN CAST((o_orderkey % 80) / 10.0D AS DECIMAL(6,1)) END AS time_taken_hours""",
                "CASE WHEN status = 'closed' THEN o_orderdate + make_dt_interval(0, o_orderkey % 72) END AS closed_at",
            )
        )

    def cost_logs(self) -> DataFrame:
        lineitem, orders = self.stored("lineitem"), self.stored("orders")
        return lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey).selectExpr(*COST_COLUMNS)

    def audit_logs(self) -> DataFrame:
        return self.stored("events").selectExpr(
            "event_id AS log_id", "user_id", "upper(event_type) AS action",
            """CASE event_id % 3 WHEN 0 THEN 'ticket' WHEN 1 THEN 'alert' ELSE 'machine' END AS entity_type""",
            "event_id % 1000 AS entity_id", "CAST(NULL AS STRING) AS old_value", "props AS new_value",
            "ts AS timestamp", "'127.0.0.1' AS ip_address",
        )

    def schedules(self) -> DataFrame:
        return self.stored("part").selectExpr(
            "p_partkey AS schedule_id", "(p_partkey * 7) % 1700 AS machine_id", "p_name AS product",
            """CASE p_size % 4 WHEN 0 THEN 'on_track' WHEN 1 THEN 'delayed' WHEN 2 THEN 'halted'
               ELSE 'cancelled' END AS status""",
            "CASE p_size % 4 WHEN 0 THEN NULL ELSE p_type END AS delay_reason",
            "CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_size * 100 END AS units_planned",
        )

    def notifications(self) -> DataFrame:
        """One notice per audit row to the user who acted; purchases and sign-ups have been read."""
        return self.stored("events").selectExpr(
            "event_id AS notification_id", "user_id", "upper(event_type) AS title",
            "props AS message", "event_type IN ('purchase', 'signup') AS read", "ts AS created_at",
        )
