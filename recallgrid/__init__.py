"""Spark-native associative retrieval engine."""
