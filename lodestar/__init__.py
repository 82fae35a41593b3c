"""lodestar: vector search, clustering and quantization on Spark DataFrames."""

__version__ = "0.1.0"
