"""Spark-native document and operations analytics: functions from DataFrames to DataFrames."""
