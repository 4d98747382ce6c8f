"""Operators that prepare training data: scans, sharding, fingerprints, deduplication, packing, mixing, search."""
