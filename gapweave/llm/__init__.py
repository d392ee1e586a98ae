"""Operators for large text corpora: quality, counts, duplicates, packing."""
