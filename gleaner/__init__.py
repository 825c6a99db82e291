"""Spark-first analytics over tables and text with auditable evidence."""

__version__ = "0.1.0"
