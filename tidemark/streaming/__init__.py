"""Streaming ingest (an extension)."""
