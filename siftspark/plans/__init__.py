"""Logical tables over the given data, and the catalogue of queries with their SQL."""
