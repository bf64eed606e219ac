"""Tagging texts with the codes of a taxonomy, as Spark jobs."""
