"""Spark-native analytics for news and document corpora."""
