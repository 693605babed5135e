"""Spark-native engine for building and validating text datasets."""
