"""Spark-native analytics over text memories and their knowledge graph."""
