"""Importing this module registers every query."""

from millwatch.plans import alarms, columns, listings, reports, streams, updates  # noqa: F401
from millwatch.plans.registry import ORACLES, QUERIES  # noqa: F401
