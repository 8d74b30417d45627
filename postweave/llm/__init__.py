"""Operators for building training corpora: dedup, archives, mixing, filters, tokens."""
