"""Operators for large text corpora: token output, quality, deduplication, packing. Nothing else in the library imports them."""
