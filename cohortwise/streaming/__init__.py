"""Incremental ingest with Structured Streaming (file sources, availableNow)."""
