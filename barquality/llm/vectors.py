"""Vectors as whole numbers: what the operators on ``embeddings`` share.

Components become ``floor(scale * x)``, so that distances, sums and ties are
exact 64-bit arithmetic and the order of rows cannot change a result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pairs of a vector and a candidate whose distances are computed at a time.
PAIRS = 1 << 16


def largest(dims: int) -> int:
    """The largest component for which every squared distance of ``dims`` components, and four times it, fits in 64 bits."""
    return math.isqrt((1 << 62) // max(dims, 1)) // 4


def integers(column: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with ``dims`` finite components, which of them are small enough to compute with, and the components of these."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), -1)).astype(np.int64)
    rows = np.flatnonzero(lengths == dims)
    flat = pc.list_flatten(column.take(pa.array(rows)))
    values = np.asarray(pc.fill_null(flat.cast(pa.float64()), math.nan), np.float64).reshape(-1, dims)
    finite = np.isfinite(values).all(1)
    rows, scaled = rows[finite], np.floor(values[finite] * scale)
    near = (np.abs(scaled) <= largest(dims)).all(1)
    return rows, near, scaled[near].astype(np.int64)


def closest(distances: np.ndarray, numbers: np.ndarray, owners: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per owner the smallest distance and, among its pairs at that distance, the smallest number.

    The pairs of an owner stand together; ``firsts`` are their first places.
    """
    least = np.minimum.reduceat(distances, firsts)
    tied = np.where(distances == least[owners], numbers, np.iinfo(np.int64).max)
    return np.minimum.reduceat(tied, firsts), least


def slices(counts: np.ndarray, most: int = PAIRS) -> Iterator[slice]:
    """Runs of owners that have about ``most`` pairs together; an owner with more is a run of its own."""
    ends = np.cumsum(counts)
    start = 0
    while start < len(counts):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + most, "right")))
        yield slice(start, stop)
        start = stop
