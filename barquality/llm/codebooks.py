"""Vector codes: product quantisation trained by filtering Lloyd rounds.

Vectors are cut into equal parts, each with its own codebook.  Every task packs
its rows into blocks and builds one kd-tree per part over a block; the trees
are written once, with the bounding box, count and sum of components of every
node.  A round walks the trees from the roots, all nodes of a level at a time:
an entry is dropped from a node when another is nearer to the whole of its
box (the corner farthest in the direction of the first decides; on a tie the
lower index stays), a node with one entry left gives its cached count and sum
at once, and only leaves with several entries left compare their own points
with those.  All numbers are whole, so codes, ties and means are exact.

A task sends one row per part and entry, whatever the number of its rows; only
codebooks (parts x entries x width numbers, all parameters) reach the driver.
The written blocks let a lost executor repeat a round without the source.

Rows whose vector is null or empty or holds null or non-finite components are
left out, and so are vectors of another length than the one with the smallest
id, or whose length the number of parts does not divide: they share no
codebook.  Null ids come last in the order of starts, equal ids by vector.
Fewer vectors than entries give as many entries as vectors.  A vector with a
component beyond ``vectors.largest`` is returned with null code and error and
takes no part.  Null labels are one group.  Repeated rows count as often as
they come; an empty table gives an empty result; other columns are ignored.
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

from .common import arrow_rows, int64_list, persist_table, slim
from .vectors import closest, integers, slices


@dataclass(frozen=True)
class Coding:
    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096
    block: int = 8192
    leaf: int = 32


@dataclass(frozen=True)
class Tree:
    """A complete kd-tree over points in leaf order; nodes stand level by level."""

    points: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray

    @property
    def depth(self) -> int:
        return (len(self.low) + 1).bit_length() - 2

    def edges(self, level: int) -> np.ndarray:
        """Where the nodes of a level begin among the points, and the end."""
        return len(self.points) * np.arange((1 << level) + 1) // (1 << level)


def planted(points: np.ndarray, leaf: int) -> tuple[Tree, np.ndarray]:
    """A tree over ``points`` and the order in which it holds them.

    All nodes of a level are split together, each at the median of its widest
    dimension.
    """
    n = len(points)
    depth = max(n // max(leaf, 1), 1).bit_length() - 1
    order = np.arange(n)
    for level in range(depth):
        edges = n * np.arange((1 << level) + 1) // (1 << level)
        inside = points[order]
        wide = (np.maximum.reduceat(inside, edges[:-1]) - np.minimum.reduceat(inside, edges[:-1])).argmax(1)
        node = np.repeat(np.arange(1 << level), np.diff(edges))
        order = order[np.lexsort((inside[np.arange(n), wide[node]], node))]
    inside = points[order]
    first = (n * np.arange((1 << depth) + 1) // (1 << depth))[:-1]
    rows = [(np.minimum.reduceat(inside, first), np.maximum.reduceat(inside, first), np.add.reduceat(inside, first))]
    for _ in range(depth):
        low, high, sums = rows[0]
        rows.insert(0, (np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2]), sums[::2] + sums[1::2]))
    return Tree(inside, *(np.concatenate([r[i] for r in rows]) for i in range(3))), order


def _kept(low: np.ndarray, high: np.ndarray, entries: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Which entries may be the nearest (lowest index on ties) of some place in each box."""
    twice = 2 * entries[None] - (low + high)[:, None]
    off = np.where(alive, (twice * twice).sum(2), np.iinfo(np.int64).max)
    star = off.argmin(1)
    best = entries[star][:, None]
    corner = np.where(entries[None] > best, high[:, None], low[:, None])
    its, bests = ((entries[None] - corner) ** 2).sum(2), ((best - corner) ** 2).sum(2)
    index = np.arange(len(entries))
    keep = alive & ((its < bests) | ((its == bests) & (index < star[:, None])))
    keep[np.arange(len(star)), star] = True
    return keep


def filtered(tree: Tree, entries: np.ndarray, codes: np.ndarray | None = None, errors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Count and sum of the points per entry, and how many distances to points were computed.

    With ``codes`` and ``errors``, the entry and the squared distance of every
    point are put there, in leaf order.
    """
    k, width = entries.shape
    counts, sums, compared = np.zeros(k, np.int64), np.zeros((k, width), np.int64), 0
    nodes, alive = np.zeros(1, np.int64), np.ones((1, k), bool)
    for level in range(tree.depth + 1):
        base, edges = (1 << level) - 1, tree.edges(level)
        keep = np.empty_like(alive)
        for part in slices(np.full(len(nodes), k * width)):
            at = base + nodes[part]
            keep[part] = _kept(tree.low[at], tree.high[at], entries, alive[part])
        alone = keep.sum(1) == 1
        whole, entry = nodes[alone], keep[alone].argmax(1)
        np.add.at(counts, entry, edges[whole + 1] - edges[whole])
        np.add.at(sums, entry, tree.sums[base + whole])
        if codes is not None:
            for node, e in zip(whole.tolist(), entry.tolist()):
                codes[edges[node] : edges[node + 1]] = e
        nodes, alive = nodes[~alone], keep[~alone]
        if level < tree.depth:
            nodes, alive = np.stack([2 * nodes, 2 * nodes + 1], 1).reshape(-1), np.repeat(alive, 2, 0)
            continue
        sizes = edges[nodes + 1] - edges[nodes]
        rows = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - edges[nodes], sizes)
        left = np.repeat(alive, sizes, 0)
        n = left.sum(1)
        for part in slices(n):
            owners, tried = np.nonzero(left[part])
            points = tree.points[rows[part]]
            off = ((points[owners] - entries[tried]) ** 2).sum(1)
            best, _ = closest(off, tried, owners, np.cumsum(n[part]) - n[part])
            counts += np.bincount(best, minlength=k)
            np.add.at(sums, best, points)
            compared += len(owners)
            if codes is not None:
                codes[rows[part]] = best
    if errors is not None:
        errors[:] = ((tree.points - entries[codes]) ** 2).sum(1)
    return counts, sums, compared


_NUMBERS = ("points", "low", "high")


def _blocks(how: Coding, dims: int, id_type: pa.DataType, label_type: pa.DataType):
    """Rows of a task in blocks, each with a tree per part; vectors out of range stand beside them."""
    width = dims // how.parts

    def block(held: list) -> pa.RecordBatch:
        ids, labels = (pa.concat_arrays([h[i] for h in held]) for i in (0, 1))
        near, values = np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held])
        inside, outside = pa.array(np.flatnonzero(near)), pa.array(np.flatnonzero(~near))
        n = len(values)
        made = [planted(values[:, i * width : (i + 1) * width], how.leaf) for i in range(how.parts)] if n else []
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        flat = lambda rows, kind: one(pa.array(np.concatenate([r.reshape(-1) for r in rows]) if rows else np.zeros(0, np.int64), kind))
        arrays = [pa.array([n], pa.int32()), one(ids.take(inside)), one(labels.take(inside)), one(ids.take(outside)), one(labels.take(outside))]
        arrays += [flat([o for _, o in made], pa.int32()), *(flat([getattr(t, x) for t, _ in made], pa.int32()) for x in _NUMBERS), flat([t.sums for t, _ in made], pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, ["n", "ids", "labels", "far_ids", "far_labels", "places", *_NUMBERS, "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, how.block):
                piece = batch.slice(at, how.block)
                rows, near, values = integers(piece.column("embedding"), dims, how.scale)
                if not len(rows):
                    continue
                if total + len(rows) > how.block:
                    yield block(held)
                    held, total = [], 0
                take = pa.array(rows)
                held.append((piece.column("vec_id").take(take).cast(id_type), piece.column("label").take(take).cast(label_type), near, values))
                total += len(rows)
        if held:
            yield block(held)

    return run


def _trees(row: dict, how: Coding, width: int) -> Iterator[Tree]:
    n = row["n"]
    arrays = {x: row[x].reshape(how.parts, -1, width) for x in (*_NUMBERS, "sums")}
    for i in range(how.parts if n else 0):
        yield Tree(*(arrays[x][i].astype(np.int64) for x in (*_NUMBERS, "sums")))


def _row(batch: pa.RecordBatch, i: int, names: tuple[str, ...]) -> dict:
    return {"n": batch.column("n")[i].as_py()} | {x: np.asarray(batch.column(x)[i].values) for x in names}


def _sums(how: Coding, width: int, sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        counts, sums = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                for part, tree in enumerate(_trees(_row(batch, i, (*_NUMBERS, "sums")), how, width)):
                    n, s, _ = filtered(tree, books[part])
                    counts[part] += n
                    sums[part] += s
        part, entry = np.nonzero(counts)
        arrays = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), int64_list(sums[part, entry].reshape(-1), np.full(len(part), width))]
        yield pa.RecordBatch.from_arrays(arrays, ["part", "entry", "n", "sums"])

    return run


def _codes(how: Coding, width: int, sent, id_type: pa.DataType, label_type: pa.DataType):
    names = ["vec_id", "label", "code", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = _row(batch, i, (*_NUMBERS, "sums", "places"))
                n, places = row["n"], row["places"].reshape(how.parts, -1)
                codes, errors = np.zeros((n, how.parts), np.uint8), np.zeros(n, np.int64)
                for part, tree in enumerate(_trees(row, how, width)):
                    found, off = np.zeros(n, np.int64), np.zeros(n, np.int64)
                    filtered(tree, books[part], found, off)
                    codes[places[part], part] = found
                    errors[places[part]] += off
                text = codes.tobytes().hex()
                step = 2 * how.parts
                shown = pa.array([text[j : j + step] for j in range(0, len(text), step)], pa.string())
                ids, labels, far, far_labels = (batch.column(x)[i].values for x in ("ids", "labels", "far_ids", "far_labels"))
                yield pa.RecordBatch.from_arrays([ids.cast(id_type), labels.cast(label_type), shown, pa.array(errors)], names)
                yield pa.RecordBatch.from_arrays([far.cast(id_type), far_labels.cast(label_type), pa.nulls(len(far), pa.string()), pa.nulls(len(far), pa.int64())], names)

    return run


def _usable() -> str:
    """Vectors that may be a start, in SQL: not empty, without null or non-finite components."""
    return "size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"


class Quantiser:
    """Codebooks over the blocks of a table of vectors."""

    def __init__(self, vectors: DataFrame, how: Coding = Coding()):
        if how.entries > 256:
            raise ValueError("an entry is coded in one byte")
        self.how, self.vectors = how, slim(vectors, "vec_id", "embedding", "label")
        self.kinds = [self.vectors.schema[c].dataType for c in ("vec_id", "label")]
        first = self.vectors.where(_usable()).orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select("embedding").limit(1).collect()
        self.dims = len(first[0]["embedding"]) if first else 0
        if self.dims % how.parts:
            self.dims = 0
        self.width = self.dims // how.parts
        self.books = np.zeros((how.parts, 0, self.width), np.int64)
        if self.dims:
            types = [to_arrow_type(k) for k in self.kinds]
            a, b = (k.simpleString() for k in self.kinds)
            numbers = ", ".join(f"{x} array<int>" for x in ("places", *_NUMBERS))
            ddl = f"n int, ids array<{a}>, labels array<{b}>, far_ids array<{a}>, far_labels array<{b}>, {numbers}, sums array<bigint>"
            self.blocks = persist_table(self.vectors.mapInArrow(_blocks(how, self.dims, *types), ddl), "kd-trees")

    def starts(self) -> np.ndarray:
        """The parts of the vectors with the smallest ids."""
        how = self.how
        kind = self.kinds[0]
        rows = self.vectors.select("vec_id", "embedding").mapInArrow(_whole(self.dims, how.scale), f"vec_id {kind.simpleString()}, v array<bigint>")
        found = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(how.entries).collect()
        values = np.array([r["v"] for r in found], np.int64).reshape(len(found), how.parts, self.width)
        return np.ascontiguousarray(values.transpose(1, 0, 2))

    def train(self) -> np.ndarray:
        """parts x entries x width: every entry as the floor of the exact mean of its parts, round after round."""
        if not self.dims:
            return self.books
        self.books = self.starts()
        context = self.vectors.sparkSession.sparkContext
        for _ in range(self.how.rounds if self.books.size else 0):
            sent = context.broadcast(self.books)
            with arrow_rows(self.vectors.sparkSession, 8):
                parts = self.blocks.select("n", *_NUMBERS, "sums").mapInArrow(_sums(self.how, self.width, sent), "part int, entry int, n bigint, sums array<bigint>")
                by_place = parts.select("part", "entry", "n", F.posexplode("sums").alias("place", "s")).groupBy("part", "entry", "place")
                means = by_place.agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
            moved = self.books.copy()
            for r in means:
                moved[r["part"], r["entry"], r["place"]] = int(r["s"]) // r["n"]
            self.books = moved
            sent.unpersist()
        return self.books

    def codes(self) -> DataFrame:
        """vec_id, label, code, error of every vector that is kept, from a written table."""
        spark = self.vectors.sparkSession
        a, b = (k.simpleString() for k in self.kinds)
        ddl = f"vec_id {a}, label {b}, code string, error bigint"
        if not self.dims:
            return spark.createDataFrame([], ddl)
        sent = spark.sparkContext.broadcast(self.books)
        with arrow_rows(spark, 8):
            return persist_table(self.blocks.mapInArrow(_codes(self.how, self.width, sent, *map(to_arrow_type, self.kinds)), ddl), "codes")

    def decoded(self, code: str) -> list[int]:
        """The whole numbers that a code stands for."""
        return [x for part, entry in enumerate(bytes.fromhex(code)) for x in self.books[part, entry].tolist()]

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.reshape(-1).tolist())).encode()).hexdigest()


def _whole(dims: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, near, values = integers(batch.column("embedding"), dims, scale)
            ids = batch.column("vec_id").take(pa.array(rows[near]))
            yield pa.RecordBatch.from_arrays([ids, int64_list(values.reshape(-1), np.full(len(values), dims))], ["vec_id", "v"])

    return run


def compress(vectors: DataFrame, how: Coding = Coding()) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector that is kept."""
    quantiser = Quantiser(vectors, how)
    quantiser.train()
    rows = quantiser.codes()
    total = F.expr("try_cast(sum(CAST(error AS decimal(38,0))) AS bigint)")
    sums = rows.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error"))
    named = rows.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return named.select("vec_id", "code", "error", "label_error", F.lit(quantiser.digest()).alias("codebooks_sha256"))
