"""Operators for large text corpora: one module each, and the queries that apply them."""
