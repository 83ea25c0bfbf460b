"""Structured Streaming forms of the import job and the run gauges."""
