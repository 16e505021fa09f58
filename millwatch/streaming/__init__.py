"""Structured Streaming forms of the alarm, scoring and event operators."""
