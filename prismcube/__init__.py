"""Spark-native multi-resolution cube engine and large-table data operators."""

__version__ = "0.1.0"
