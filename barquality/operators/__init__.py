"""Operators over bars, each a function from DataFrame to DataFrame."""
