"""Structured Streaming ingestion and incremental screening."""
