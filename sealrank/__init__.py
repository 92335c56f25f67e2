"""Private vector search and retrieval evaluation on Spark."""

__version__ = "0.1.0"
