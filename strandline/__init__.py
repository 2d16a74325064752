"""Spark-native analytics for ordered sequences and time-aligned events."""

__version__ = "0.1.0"
