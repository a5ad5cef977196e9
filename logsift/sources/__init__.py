"""Readers and file catalogs."""
