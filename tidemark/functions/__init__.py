"""Column functions: entry encoding, checksums, Bloom filters."""
