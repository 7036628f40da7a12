"""Operators for large text corpora: each takes a DataFrame and returns one."""
