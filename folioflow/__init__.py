"""Spark-native document text and reading analytics."""
