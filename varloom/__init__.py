"""Spark-native statistical genomics, with optional training-data operators in ``varloom.llm``."""

__version__ = "0.1.0"
