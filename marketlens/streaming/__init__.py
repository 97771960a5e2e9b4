"""Incremental forms of the daily loads."""
