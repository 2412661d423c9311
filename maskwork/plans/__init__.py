"""Composed queries, reports and SQL functions."""
