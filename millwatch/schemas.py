"""Declared tables, value domains, defaults and alarm limits."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "STRING": T.StringType(), "DOUBLE": T.DoubleType(), "INT": T.IntegerType(),
    "BOOLEAN": T.BooleanType(), "TIMESTAMP": T.TimestampType(), "MONEY": T.DecimalType(18, 2),
}


def _schema(columns: str) -> T.StructType:
    pairs = [column.split() for column in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


TABLES: dict[str, T.StructType] = {
    name: _schema(columns)
    for name, columns in {
        "machines": """machine_id STRING, name STRING, location STRING, type STRING,
            assigned_operator_id STRING, health_score DOUBLE, risk_level STRING, rul_hours DOUBLE,
            status STRING, last_updated TIMESTAMP""",
        "sensor_readings": """reading_id STRING, machine_id STRING, timestamp TIMESTAMP,
            temperature DOUBLE, vibration DOUBLE, pressure DOUBLE, current DOUBLE, rpm DOUBLE,
            noise_level DOUBLE""",
        "ml_predictions": """prediction_id STRING, machine_id STRING, timestamp TIMESTAMP,
            health_score DOUBLE, risk_level STRING, rul_hours DOUBLE, failure_type STRING,
            confidence DOUBLE, model_version STRING""",
        "alerts": """alert_id STRING, machine_id STRING, triggered_at TIMESTAMP, severity STRING,
            status STRING, operator_response STRING, auto_escalated BOOLEAN,
            escalated_at TIMESTAMP""",
        "tickets": """ticket_id STRING, machine_id STRING, alert_id STRING, operator_id STRING,
            mechanic_id STRING, manager_id STRING, status STRING, description STRING,
            photo_url STRING, voice_note_url STRING, repair_cost MONEY,
            repair_report STRING, parts_used STRING, time_taken_hours DOUBLE, escalated BOOLEAN,
            created_at TIMESTAMP, closed_at TIMESTAMP""",
        "cost_logs": """cost_id STRING, ticket_id STRING, machine_id STRING, amount MONEY,
            month INT, year INT, approved_by STRING, created_at TIMESTAMP""",
        "users": """user_id STRING, name STRING, email STRING, role STRING, is_active BOOLEAN,
            created_at TIMESTAMP""",
        "mechanics": """mechanic_id STRING, skill_type STRING, login_status STRING,
            current_assignment_id STRING, shift STRING, contact STRING""",
        "audit_logs": """log_id STRING, user_id STRING, action STRING, entity_type STRING,
            entity_id STRING, old_value STRING, new_value STRING, timestamp TIMESTAMP,
            ip_address STRING""",
        "production_schedules": """schedule_id STRING, machine_id STRING, product STRING,
            start_time TIMESTAMP, end_time TIMESTAMP, status STRING, delay_reason STRING,
            units_planned INT""",
        "notifications": """notification_id STRING, user_id STRING, title STRING, message STRING,
            read BOOLEAN, created_at TIMESTAMP""",
    }.items()
}

# What a column holds when the writer left it out.
DEFAULTS: dict[str, dict[str, object]] = {
    "machines": {"health_score": 100.0, "risk_level": "low", "rul_hours": 1000.0, "status": "normal"},
    "alerts": {"status": "pending", "auto_escalated": False},
    "tickets": {"status": "open", "escalated": False},
    "users": {"is_active": True},
    "mechanics": {"login_status": "offline"},
    "production_schedules": {"status": "on_track", "units_planned": 1000},
    "notifications": {"read": False},
}

# The legal words of each enumeration.
RISK_LEVELS = ["low", "medium", "high", "critical"]
MACHINE_STATUSES = ["normal", "warning", "critical", "offline", "maintenance"]
SEVERITIES = ["low", "medium", "high", "critical"]
ALERT_STATUSES = ["pending", "acknowledged", "escalated", "resolved"]
OPERATOR_RESPONSES = ["reported", "ignored"]
TICKET_STATUSES = [
    "open", "assigned", "accepted", "in_progress", "paused", "repaired", "reviewed", "closed",
]
ROLES = [
    "operator", "mechanic", "maintenance_manager", "production_manager", "factory_owner", "admin",
]
MECHANIC_STATUSES = ["available", "busy", "offline"]
SCHEDULE_STATUSES = ["on_track", "delayed", "halted", "cancelled", "at_risk"]

ACTIVE_ALERT = ["pending", "escalated"]
FINISHED_TICKET = ["closed", "reviewed"]

SENSORS = ["temperature", "vibration", "pressure", "current", "rpm", "noise_level"]

# Limits of the ingest alarm (strictly above).
INGEST_LIMITS = {"temperature": 85.0, "vibration": 0.65}
# Warning and critical limits of the dashboard gauges (at or above).
GAUGE_LIMITS = {
    "temperature": (70.0, 90.0),
    "vibration": (5.0, 10.0),
    "pressure": (8.0, 12.0),
    "current": (15.0, 20.0),
    "rpm": (3000.0, 3600.0),
    "noise_level": (80.0, 95.0),
}
# The narrower limits of the settings page.
SETTINGS_LIMITS = {
    "temperature": (75.0, 85.0),
    "vibration": (0.45, 0.65),
    "pressure": (110.0, 130.0),
}

ESCALATION_MINUTES = 5
WATERMARK = "10 minutes"
