"""Spark-first claim graph engine."""
