"""Measure text corpora and compare them with each other as Spark DataFrame jobs."""

__version__ = "0.1.0"
