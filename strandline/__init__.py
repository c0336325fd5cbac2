"""Spark-native engine for coordinate-interval and sequence data."""

__version__ = "0.1.0"
