"""Spark-native corpus curation, evaluation analytics and retrieval."""
