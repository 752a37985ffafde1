"""Spark-native fixed-point analytics: value models as DataFrames."""
