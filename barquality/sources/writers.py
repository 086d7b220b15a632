"""Frames as files that the readers take: fixtures, and what is handed on to others."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, by: list[str] | None = None, files_of: int | None = None) -> None:
    """Text with a header per file; nulls are empty, times ISO, ``files_of`` limits the rows of a file."""
    _parts(df.write.option("header", True).option("nullValue", "").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), by, files_of).csv(path)


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None, files_of: int | None = None) -> None:
    _parts(df.write, by, files_of).parquet(path)


def _parts(writer, by: list[str] | None, files_of: int | None):
    writer = writer.partitionBy(*by) if by else writer
    return writer.option("maxRecordsPerFile", files_of) if files_of else writer
