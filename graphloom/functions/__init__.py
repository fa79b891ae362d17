"""Scalar functions and full-text search over columns."""
