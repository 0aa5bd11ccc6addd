"""Spark-native analytics operators: DataFrames in, DataFrames out."""
