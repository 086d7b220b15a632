"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word of a text; ``bytes.split()`` on the UTF-8 form yields exactly these.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where a session has none (unit tests) a temporary folder of this
    machine is set, which is right for a local master alone.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    at = tempfile.mkdtemp(prefix="barquality-")
    spark.sparkContext.setCheckpointDir(at)
    return at


def persist_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    Cuts the lineage with files that outlive any executor; the reader sees
    real file sizes, so later joins are planned from them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """For the jobs inside, so many rows at most go to a Python worker at a time; for tables with very wide rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def slim(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra columns never clash by name."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def boxed(df: DataFrame, **inner: Column) -> DataFrame:
    """All columns of ``df`` as one struct ``doc`` beside columns of our own, so that no name can clash; ``select("doc.*")`` undoes it."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc"), *[c.alias(name) for name, c in inner.items()])


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every text; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def texts_of(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (murmur finaliser)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def pieces(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20):
    """Slices of a batch whose texts add up to about ``most_bytes``.

    A single text longer than that is a slice of its own, so memory follows
    the longest text and not the number of rows in a batch.
    """
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)
    # what Arrow holds for later goes back, as many workers share a machine
    pa.default_memory_pool().release_unused()


def release() -> None:
    """Give unused memory back at the end of a task: workers live on, and many share a machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def int64_list(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A list<int64> array from flat values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))
