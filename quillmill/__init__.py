"""Spark-native document indexing and training-data engine."""
