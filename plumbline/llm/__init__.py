"""Operators for building training corpora: filtering, deduplication, tokens and packing."""
