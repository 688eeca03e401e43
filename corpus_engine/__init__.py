"""Spark-native engine for building, maintaining and searching web knowledge bases."""

__version__ = "0.1.0"
