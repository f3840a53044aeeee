"""Spark-native crop-forecast and land-use analytics."""

__version__ = "0.1.0"
