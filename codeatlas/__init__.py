"""Spark-native retrieval over code and text: symbols, call graph, full-text search."""

__version__ = "0.2.0"
