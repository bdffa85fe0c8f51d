"""Spark-native commerce analytics."""
