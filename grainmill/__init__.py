"""Spark-first analytics over source-code and text corpora."""
