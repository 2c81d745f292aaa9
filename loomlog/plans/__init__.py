"""Composite queries that chain operators: a turn, compression, restoring, search."""
