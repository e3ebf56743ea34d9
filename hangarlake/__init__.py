"""Spark-native analytics engine for short, noisy maintenance records."""

__version__ = "0.1.0"
