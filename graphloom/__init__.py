"""Spark-first analytics over code-knowledge graphs, ledgers and text corpora."""

__version__ = "0.1.0"
