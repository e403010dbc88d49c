"""Tessera: a Spark-native engine for governed text corpora."""

__version__ = "0.1.0"
