"""Scriptorium: literature corpus processing as Spark jobs."""
