"""Spark-native retrieval, open-set evaluation and corpus preparation."""
