"""Spark-native language identification and corpus curation."""

__version__ = "0.1.0"
