"""Spark-first reconciliation analytics."""
