"""Incremental ingest of chunk tables."""
