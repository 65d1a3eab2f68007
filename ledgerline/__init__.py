"""Spark-native retrieval, ranking and evaluation engine."""
