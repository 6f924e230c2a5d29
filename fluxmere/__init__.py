"""Spark-native channel/operator analytics engine."""

__version__ = "0.1.0"
