"""Incremental ingestion of edges."""
