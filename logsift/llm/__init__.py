"""Operators for preparing text corpora; the rest of the library does not import them."""
