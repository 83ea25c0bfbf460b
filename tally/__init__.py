"""Incremental ledger ingestion and rule classification on Spark."""

__version__ = "0.1.0"
