"""Spark-first document retrieval, text processing and evaluation engine."""
