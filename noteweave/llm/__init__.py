"""Operators for large-scale training-data preparation (see queries.py)."""
