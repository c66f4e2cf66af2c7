"""Operators that prepare training data: deduplication, filtering, packing, archives and search."""
