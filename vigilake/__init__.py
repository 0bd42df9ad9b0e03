"""Spark-native incident analytics: DataFrame-in, DataFrame-out operators."""
