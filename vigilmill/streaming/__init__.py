"""Incremental ingestion and the append-only extraction log."""
