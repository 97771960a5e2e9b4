"""Composed jobs, derived views of the test tables, and the registered queries."""
