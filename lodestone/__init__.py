"""Engineering-knowledge analytics on Spark: indexing, retrieval, linkage and change impact."""

__version__ = "0.1.0"
