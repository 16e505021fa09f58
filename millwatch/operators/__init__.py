"""Batch operators: DataFrames in, lazy DataFrames out."""
