"""Spark-native privacy analytics over text, pages, logs and events."""
