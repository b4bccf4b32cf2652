"""lawmill: retrieval, corpus analytics and change tracking for versioned documents on Spark DataFrames."""

__version__ = "0.1.0"
