"""Spark-native retrieval, evidence and evaluation engine."""
