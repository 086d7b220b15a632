"""Training-data operators: quality, deduplication, mixing, scoring, extraction.

Nothing outside this package imports it.  Every module states how it treats
nulls, empty and very long texts, ties, repeated rows, empty tables and extra
columns.
"""
