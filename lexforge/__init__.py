"""lexforge: terminology preparation over document collections, expressed as Spark DataFrames."""

__version__ = "0.1.0"
