"""Centroid clustering by annulus search (Lloyd's rounds over whole numbers).

Centroids are sorted by norm.  A vector's distance to any one centroid bounds
that to its nearest, and by the triangle inequality a centroid within that
bound has a norm within it of the vector's.  So each vector takes the bound
from the centroids whose norms lie next to its own, finds by binary search the
run of centroids whose norms are inside the annulus, and compares exactly
those; the edges of the annulus are widened by more than rounding can move
them, so a centroid that ties on the boundary is always compared.

Each round is one narrow pass over the vectors: a task sends the count and the
sum of components per cluster, so a cluster with a third of all rows costs one
row per task.  Only centroids (``k`` times ``dims`` numbers) reach the driver
and are sent to the workers; both are parameters and do not grow with the data.

Rows whose vector is null, has another length, or holds null or non-finite
components are left out.  Repeated rows and equal ids count as often as they
come; among starts with equal digests the smaller vector comes first; a null id
is hashed as an empty one.  With fewer vectors than ``k`` there are as many
centroids as vectors.  A vector with a component beyond ``vectors.largest`` has
no 64-bit distance: it is returned with null cluster and figures, and takes no
part.  Sums of distances beyond 64 bits are null.  An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import int64_list, persist_table, slim
from .vectors import closest, integers, slices


class Annuli:
    """Centroids by norm, for the search of the nearest."""

    def __init__(self, centroids: np.ndarray):
        norms = np.sqrt((centroids * centroids).sum(1).astype(np.float64))
        self.numbers = np.argsort(norms, kind="stable")
        self.norms, self.rows = norms[self.numbers], centroids[self.numbers]

    def bounds(self, x: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """The squared distance to the nearer of the two centroids next in norm."""
        at = np.searchsorted(self.norms, norms)
        sides = [self.rows[np.clip(at - i, 0, len(self.rows) - 1)] for i in (0, 1)]
        return np.minimum(*(((x - c) ** 2).sum(1) for c in sides))

    def runs(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end of the run of centroids inside each vector's annulus."""
        norms = np.sqrt((x * x).sum(1).astype(np.float64))
        reach = np.sqrt(self.bounds(x, norms).astype(np.float64))
        reach += 1e-9 * (norms + reach + 1)
        return np.searchsorted(self.norms, norms - reach, "left"), np.searchsorted(self.norms, norms + reach, "right")

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number of and squared distance to the nearest centroid of each vector, and how many were compared."""
        numbers, distances = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        if not len(x):
            return numbers, distances, 0
        first, end = self.runs(x)
        counts = end - first
        for part in slices(counts):
            n = counts[part]
            owners, firsts = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
            tried = np.arange(len(owners)) - np.repeat(firsts - first[part], n)
            off = ((x[part][owners] - self.rows[tried]) ** 2).sum(1)
            numbers[part], distances[part] = closest(off, self.numbers[tried], owners, firsts)
        return numbers, distances, int(counts.sum())


@dataclass(frozen=True)
class Clustering:
    k: int = 16
    rounds: int = 3
    dims: int = 64
    scale: int = 64
    seed: str = "1"


def _whole(how: Clustering, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, near, values = integers(batch.column("embedding"), how.dims, how.scale)
            ids = batch.column("vec_id").take(pa.array(rows[near])).cast(id_type)
            yield pa.RecordBatch.from_arrays([ids, int64_list(values.reshape(-1), np.full(len(values), how.dims))], ["vec_id", "v"])

    return run


def starts(vectors: DataFrame, how: Clustering) -> np.ndarray:
    """The vectors with the smallest digests of their ids."""
    kind = vectors.schema["vec_id"].dataType
    whole = vectors.mapInArrow(_whole(how, to_arrow_type(kind)), f"vec_id {kind.simpleString()}, v array<bigint>")
    digest = F.sha2(F.concat(F.lit(f"{how.seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    found = whole.select(digest.alias("digest"), "v").orderBy("digest", "v").limit(how.k).collect()
    return np.array([r["v"] for r in found], np.int64).reshape(-1, how.dims)


def _sums(how: Clustering, sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Annuli(sent.value)
        counts, sums = np.zeros(how.k, np.int64), np.zeros((how.k, how.dims), np.int64)
        for batch in batches:
            values = integers(batch.column("embedding"), how.dims, how.scale)[2]
            numbers = search.nearest(values)[0]
            counts += np.bincount(numbers, minlength=how.k)
            order = np.argsort(numbers, kind="stable")
            met, at = np.unique(numbers[order], return_index=True)
            if len(met):
                sums[met] += np.add.reduceat(values[order], at)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used]), int64_list(sums[used].reshape(-1), np.full(len(used), how.dims))], ["cluster", "n", "sums"])

    return run


def _moved(vectors: DataFrame, centroids: np.ndarray, how: Clustering) -> np.ndarray:
    """Every centroid with vectors as the floor of their exact mean."""
    sent = vectors.sparkSession.sparkContext.broadcast(centroids)
    parts = vectors.select("embedding").mapInArrow(_sums(how, sent), "cluster int, n bigint, sums array<bigint>")
    by_place = parts.select("cluster", "n", F.posexplode("sums").alias("place", "s")).groupBy("cluster", "place")
    out = centroids.copy()
    for r in by_place.agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
        out[r["cluster"], r["place"]] = int(r["s"]) // r["n"]
    sent.unpersist()
    return out


def _assigned(how: Clustering, sent, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Annuli(sent.value)
        for batch in batches:
            rows, near, values = integers(batch.column("embedding"), how.dims, how.scale)
            numbers, distances, tried = search.nearest(values)
            shown = np.cumsum(near) - 1
            at = pa.array(shown, mask=~near)
            ids = batch.column("vec_id").take(pa.array(rows)).cast(id_type)
            yield pa.RecordBatch.from_arrays([ids, pa.array(numbers, pa.int32()).take(at), pa.array(distances).take(at)], ["vec_id", "cluster", "distance"])

    return run


def train(vectors: DataFrame, how: Clustering = Clustering()) -> np.ndarray:
    """The centroids after all rounds, ``k`` rows of whole numbers."""
    vectors = slim(vectors, "vec_id", "embedding")
    centroids = starts(vectors, how)
    for _ in range(how.rounds if len(centroids) else 0):
        centroids = _moved(vectors, centroids, how)
    return centroids


def assign(vectors: DataFrame, centroids: np.ndarray, how: Clustering = Clustering()) -> DataFrame:
    """vec_id, cluster, distance (squared) of every vector that is kept."""
    vectors = slim(vectors, "vec_id", "embedding")
    kind = vectors.schema["vec_id"].dataType
    sent = vectors.sparkSession.sparkContext.broadcast(centroids)
    return vectors.mapInArrow(_assigned(how, sent, to_arrow_type(kind)), f"vec_id {kind.simpleString()}, cluster int, distance bigint")


def cluster(vectors: DataFrame, how: Clustering = Clustering()) -> DataFrame:
    """``assign`` after ``train``, with the sums of distances per cluster and over all and a digest of the centroid."""
    spark = vectors.sparkSession
    centroids = train(vectors, how)
    rows = persist_table(assign(vectors, centroids, how), "clustered")
    # a row per cluster at most: k is a parameter
    sums = {r["cluster"]: int(r["s"]) for r in rows.where("cluster is not null").groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = sum(sums.values())
    most = np.iinfo(np.int64).max
    figures = [
        (i, s if (s := sums.get(i, 0)) <= most else None, total if total <= most else None, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest())
        for i, c in enumerate(centroids)
    ]
    named = spark.createDataFrame(figures, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(named), "cluster", "left").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
