"""Spark-first engine for building, indexing and rewriting text corpora."""

__version__ = "0.1.0"
