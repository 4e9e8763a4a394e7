"""Tessera: a Spark-native code knowledge base and corpus-processing engine."""

__version__ = "0.2.0"
