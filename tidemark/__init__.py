"""Tidemark: a Spark-native engine for systematic-trading research."""
