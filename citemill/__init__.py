"""Spark-first engine for script-citation statistics and corpus analytics."""

__version__ = "0.1.0"
