"""Spark-native analytics for business tables."""
