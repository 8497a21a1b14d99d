"""Spark-native analytics for cell morphometry."""
