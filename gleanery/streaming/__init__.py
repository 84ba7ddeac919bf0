"""Incremental batch steps."""
