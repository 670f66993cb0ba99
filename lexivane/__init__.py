"""lexivane: batch retrieval over learned sparse vectors, and data preparation, as Spark plans."""

__version__ = "0.1.0"
