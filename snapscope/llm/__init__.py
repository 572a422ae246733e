"""Operators for large-scale training data: one module each, queries in `queries`."""
