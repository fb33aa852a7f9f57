"""Versioned vector retrieval and large-corpus analytics on Spark DataFrames."""

__version__ = "0.1.0"
