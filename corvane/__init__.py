"""Corvane: a Spark-native engine for mission corpora and training-data pipelines."""
