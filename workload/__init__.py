"""Queries over the given tables, one per operator, and the same results in SQL."""
