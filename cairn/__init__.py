"""cairn: epoch-structured key-value analytics expressed with Spark DataFrames."""

__version__ = "0.1.0"
