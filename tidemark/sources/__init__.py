"""Durable parts: commit files, segments, the manifest, and the store over them."""
