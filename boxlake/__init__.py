"""Spark-first analytics for object-detection annotations and training-data pipelines."""
