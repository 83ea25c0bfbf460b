"""Composite jobs: import, classify, and the driver-table query set."""
