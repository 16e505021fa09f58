"""Registered queries, each beside the SQL it must agree with."""
