"""Scalar functions over columns; all of them built-in expressions."""
