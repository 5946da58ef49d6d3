"""Spark-native engine for hierarchical document tagging and corpus processing."""

__version__ = "0.1.0"
