"""Spark-native engine for JSON documents and training-data text, built on DataFrames."""

__version__ = "0.1.0"
