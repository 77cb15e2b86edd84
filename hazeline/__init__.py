"""Spark-native library for daily environmental-sensor readings."""
