"""Spark-native retrieval over large collections of source and text files."""

__version__ = "0.1.0"
