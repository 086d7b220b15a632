"""Vendor files as raw frames with provenance."""

from __future__ import annotations

import csv
import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from pathlib import Path, PurePosixPath
from typing import Protocol
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import written

SOURCE_FILE, ROW_NUMBER = "__source_file", "__row_number"
#: Fixed value: texts that a CSV file uses for null.
NULL_TOKENS = ("", "NA", "N/A", "null", "NULL", "NaN")


class UnsupportedFileError(ValueError):
    """No reader is known for a file's suffix."""


class FileReader(Protocol):
    """Reads files of some suffixes; further readers can be registered."""

    suffixes: tuple[str, ...]

    def read(self, spark: SparkSession, *paths: str) -> DataFrame: ...


def numbered(placed: DataFrame, unit: list[str], part: str, at: str) -> DataFrame:
    """Adds ROW_NUMBER, from 1 in each unit: a row's number inside its part, after the counts of the parts before.

    Only one row per part is ordered per unit; the rows of a unit never meet.
    """
    counts = placed.groupBy(*unit, part).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*unit).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*unit, part, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*unit, part).orderBy(at))
    met = placed.withColumn("_inside", inside).join(before, [*unit, part])
    kept = [F.col(f"`{c}`") for c in placed.columns if c not in (part, at)]
    return met.select(*kept, (F.col("_before") + F.col("_inside")).cast("bigint").alias(ROW_NUMBER))


class CsvReader:
    """All columns as text; short rows are padded, long ones cut, null tokens read as null.

    Files are read in blocks, and rows are numbered by the counts of the blocks
    before, so a long file is as many tasks as it has blocks.
    """

    suffixes = (".csv", ".txt")

    def read(self, spark: SparkSession, *paths: str) -> DataFrame:
        raw = spark.read.option("header", True).option("mode", "PERMISSIVE").option("inferSchema", False).csv(list(paths))
        texts = [F.when(F.col(f"`{c}`").isin(*NULL_TOKENS), None).otherwise(F.col(f"`{c}`")).alias(c) for c in raw.columns]
        placed = raw.select(*texts, F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
        out = numbered(placed, ["_path"], "_block", "_at")
        return out.select(*[F.col(f"`{c}`") for c in raw.columns], _local(F.col("_path")).alias(SOURCE_FILE), ROW_NUMBER)


class ParquetReader:
    """Native types; the reader knows each row's number in its file."""

    suffixes = (".parquet", ".pq")

    def read(self, spark: SparkSession, *paths: str) -> DataFrame:
        raw = spark.read.parquet(*paths)
        return raw.select("*", _local(F.col("_metadata.file_path")).alias(SOURCE_FILE), (F.col("_metadata.row_index") + 1).alias(ROW_NUMBER))


def _local(path):
    return F.regexp_replace(F.url_decode(path), "^file:(//)?", "")


READERS: dict[str, FileReader] = {s: r for r in (CsvReader(), ParquetReader()) for s in r.suffixes}


def register(reader: FileReader) -> None:
    READERS.update({s: reader for s in reader.suffixes})


def _reader(path: str) -> FileReader:
    suffix = PurePosixPath(path).suffix.lower()
    if suffix not in READERS:
        raise UnsupportedFileError(f"{path}: suffix {suffix!r} is not one of {', '.join(sorted(READERS))}")
    return READERS[suffix]


def read_file(spark: SparkSession, path: str | Path) -> DataFrame:
    return _reader(str(path)).read(spark, str(path))


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files of one reader and one header in one plan."""
    return _reader(paths[0]).read(spark, *paths)


def expand(spark: SparkSession, paths: list[str | Path]) -> list[str]:
    """The files of paths, folders (with all below) and patterns, sorted, each once; what is missing is left out.

    Spark lists them, so they may be in any file system that it reads, and
    large folders are listed in parallel.
    """
    found: set[str] = set()
    for p in paths:
        listing = spark.read.format("binaryFile").option("recursiveFileLookup", True)
        try:
            found.update(listing.load(str(p)).inputFiles())
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    local = {re.sub("^file:(//)?(?=/)", "", unquote(f)) for f in found}
    return sorted(f for f in local if PurePosixPath(f).suffix.lower() in READERS)


@dataclass(frozen=True)
class Alike:
    """Files that one plan can read: one reader, one header, one kind."""

    header: tuple[str, ...]
    kind: str
    files: list[str]


def header(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The column names of a file; of text only the first line is read."""
    if not isinstance(_reader(path), CsvReader):
        return tuple(_reader(path).read(spark, path).columns)
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine()
    finally:
        stream.close()
    return tuple(next(csv.reader([line.removeprefix("\ufeff")]), ())) if line else ()


def by_header(spark: SparkSession, files: list[str], kind_of) -> list[Alike]:
    """Files grouped by reader, header and ``kind_of(columns, path)``; headers are read side by side."""
    groups: dict[tuple, list[str]] = {}
    with ThreadPoolExecutor(16) as pool:
        for path, names in zip(files, pool.map(lambda f: header(spark, f), files)):
            groups.setdefault((_reader(path).suffixes, names, kind_of(list(names), path)), []).append(path)
    return [Alike(names, kind, paths) for (_, names, kind), paths in groups.items()]


def from_frame(df: DataFrame, source: str = "<memory>") -> DataFrame:
    """A frame as a source: provenance is added where it is missing.

    To be numbered, the frame is written once with the place of each row, so
    that numbers cannot change when a task runs again.
    """
    if SOURCE_FILE not in df.columns:
        df = df.withColumn(SOURCE_FILE, F.lit(source))
    if ROW_NUMBER not in df.columns:
        placed = written(df.withColumn("_at", F.monotonically_increasing_id()), "placed")
        # the task that made a row stands in the upper bits of its place
        df = numbered(placed.withColumn("_part", F.shiftright("_at", 33)), [SOURCE_FILE], "_part", "_at")
    return df
