"""Spark-native document intelligence, reporting and training-data engine."""
