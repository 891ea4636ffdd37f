"""Spark-native positional text search."""
