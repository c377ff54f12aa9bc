"""Registered queries and the SQL that says what each must return."""

from catalog import files, learnt, measures, models, samples, streams, tables, text, vocabulary
from catalog.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "files", "learnt", "measures", "models", "samples", "streams", "tables", "text", "vocabulary"]
