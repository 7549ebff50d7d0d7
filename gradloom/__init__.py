"""Spark-native gradient boosting on DataFrames."""
