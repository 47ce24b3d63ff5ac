"""Readers, writers and the paged-API data source."""
