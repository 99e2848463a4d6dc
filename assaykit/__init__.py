"""Spark jobs that measure the quality and stability of structured extraction."""
