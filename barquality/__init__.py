"""A PySpark-native engine for OHLCV bar data: ingest, analytics, quality, evidence."""

__version__ = "0.1.0"
