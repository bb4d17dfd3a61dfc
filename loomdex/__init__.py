"""loomdex: batch retrieval, document indexing and corpus repair on Spark DataFrames."""

__version__ = "0.1.0"
