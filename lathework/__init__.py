"""Spark-native batch planning for file-processing pipelines."""
