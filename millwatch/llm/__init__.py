"""Operators of a training-data pipeline, with their registered queries in ``queries``."""
