"""Joins, aggregations, windows and table maintenance."""
