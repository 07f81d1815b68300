"""Incremental SQL analytics on Spark."""
