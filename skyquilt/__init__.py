"""Scenery-data analytics as Spark jobs."""
