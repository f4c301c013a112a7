"""Spark-first sparse linear algebra and benchmark analytics."""
