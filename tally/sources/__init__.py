"""Scans, manifests and the table store."""
