"""Spark-first analytics for incremental transcript and text streams."""

__version__ = "0.1.0"
