"""Operators for large text corpora: deduplication, counting, extraction, filtering, mixing."""
