"""Multi-vector retrieval on Spark: bags of vectors in, ranked documents out."""

__version__ = "0.1.0"
