"""Spark-first analytics over collections of Markdown notes."""
