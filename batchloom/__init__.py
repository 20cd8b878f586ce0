"""Spark-first analytics over batch-job orchestration data."""
