"""Clustering and codes against plain Python: every distance, every round."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from barquality.llm import centroids, codebooks, vectors

SCHEMA = "vec_id bigint, embedding array<float>, label int, cluster string, n int"


def rows_of(rng, n, dims=64, groups=5):
    middles = [[rng.gauss(0, 0.3) for _ in range(dims)] for _ in range(groups)]
    return [(i, [float(np.float32(m + rng.gauss(0, 0.1))) for m in rng.choice(middles)], rng.choice([None, 1, 2]), "x", 1) for i in range(n)]


def odd(dims=64):
    one = [0.25] * dims
    return [
        (900, None, 1, "x", 1), (901, [], 1, "x", 1), (902, [0.5] * (dims - 1) + [None], 1, "x", 1), (903, [0.5] * (dims - 1) + [math.nan], 1, "x", 1), (904, [0.5] * (dims - 1) + [-math.inf], 1, "x", 1),
        (905, [0.5] * (dims - 2), 1, "x", 1), (906, one, None, "x", 1), (906, one, None, "x", 1), (907, [-0.0] * dims, 2, "x", 1), (None, one, 2, "x", 1),
    ]


def kept(rows, dims, scale):
    good = [r for r in rows if r[1] is not None and len(r[1]) == dims and all(x is not None and math.isfinite(x) for x in r[1])]
    return [(r[0], [math.floor(scale * x) for x in r[1]], r[2]) for r in good]


def apart(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def nearest(v, books):
    return min((apart(v, b), i) for i, b in enumerate(books))


def moved(values, books):
    groups = [[v for v in values if nearest(v, books)[1] == i] for i in range(len(books))]
    return [[sum(c) // len(g) for c in zip(*g)] if g else b for g, b in zip(groups, books)]


def plain_clusters(rows, k, rounds):
    vecs = kept(rows, 64, 64)
    order = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v, _ in vecs)
    books = [v for _, v in order[:k]]
    for _ in range(rounds):
        books = moved([v for _, v, _ in vecs], books)
    found = [(i, *reversed(nearest(v, books))) for i, v, _ in vecs]
    total = sum(d for *_, d in found)
    sha = [hashlib.sha256(",".join(map(str, b)).encode()).hexdigest() for b in books]
    return [(i, c, d, sum(e for _, x, e in found if x == c), total, sha[c]) for i, c, d in found]


def plain_codes(rows, how, dims):
    vecs, w = kept(rows, dims, how.scale), dims // how.parts
    first = sorted(vecs, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[: how.entries]
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = []
    for p in range(how.parts):
        book = [cut(v, p) for _, v, _ in first]
        for _ in range(how.rounds):
            book = moved([cut(v, p) for _, v, _ in vecs], book)
        books.append(book)
    met = [[nearest(cut(v, p), books[p]) for p in range(how.parts)] for _, v, _ in vecs]
    errors = [sum(d for d, _ in m) for m in met]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{e:02x}" for _, e in m), err, sum(x for x, (*_, other) in zip(errors, vecs) if other == label), sha) for (i, _, label), m, err in zip(vecs, met, errors)]


@pytest.mark.parametrize("k", [1, 16])
def test_clusters_equal_the_plain_rounds(spark, k):
    rows = rows_of(random.Random(k), 150) + odd()
    got = centroids.cluster(spark.createDataFrame(rows, SCHEMA).repartition(3), centroids.Clustering(k=k))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain_clusters(rows, k, 3)))


def test_few_vectors_and_empty_tables(spark):
    rows = rows_of(random.Random(3), 5)
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, centroids.cluster(df).collect())) == sorted(plain_clusters(rows, 16, 3))
    assert sorted(map(tuple, codebooks.compress(df).collect())) == sorted(plain_codes(rows, codebooks.Coding(), 64))
    for none in (df.where("false"), spark.createDataFrame([(1, None, 1, "x", 1), (2, [], 1, "x", 1)], SCHEMA)):
        assert centroids.cluster(none).collect() == [] and codebooks.compress(none).collect() == []


def test_vectors_out_of_range_are_returned_without_figures(spark):
    rows = rows_of(random.Random(4), 20)
    df = spark.createDataFrame([*rows, (99, [1e30] * 64, 1, "x", 1)], SCHEMA)
    got = {r["vec_id"]: r for r in centroids.cluster(df).collect()}
    assert tuple(got.pop(99))[1:3] == (None, None)
    assert sorted(map(tuple, got.values())) == sorted(plain_clusters(rows, 16, 3))
    got = {r["vec_id"]: r for r in codebooks.compress(df).collect()}
    assert got[99]["code"] is None and got[99]["error"] is None
    assert {i: (r["code"], r["error"]) for i, r in got.items() if i != 99} == {i: (c, e) for i, c, e, *_ in plain_codes(rows, codebooks.Coding(), 64)}


def test_annulus_compares_few_and_every_tie():
    rng = np.random.default_rng(1)
    books = rng.integers(-40, 40, (300, 8)) * 2 ** rng.integers(0, 9, (300, 1))
    books = np.concatenate([books, books[:40], -books[:40]])
    x = np.concatenate([books[::3], books[rng.integers(0, 340, 2000)] + rng.integers(-9, 9, (2000, 8)), np.zeros((3, 8), np.int64)])
    number, distance, compared = centroids.Annuli(books).nearest(x)
    want = ((x[:, None] - books[None]) ** 2).sum(2)
    assert (number == want.argmin(1)).all() and (distance == want.min(1)).all()
    assert compared < want.size / 2


@pytest.mark.parametrize("case", ["normal", "groups", "equal", "line", "few"])
def test_filtered_trees_equal_all_comparisons(case):
    rng = np.random.default_rng(7)
    n = 9 if case == "few" else 3000
    points = {
        "normal": rng.integers(-50, 50, (n, 4)), "groups": rng.integers(-3, 3, (n, 4)) + 100 * rng.integers(0, 4, (n, 1)), "equal": np.full((n, 4), 7), "line": np.arange(n)[:, None] * np.array([[1, 0, 0, 2]]), "few": rng.integers(-50, 50, (n, 4)),
    }[case]
    entries = np.concatenate([points[:7], points[:3], points[:2] + 1])
    tree, order = codebooks.planted(points, 16)
    codes, errors = np.zeros(n, np.int64), np.zeros(n, np.int64)
    counts, sums, compared = codebooks.filtered(tree, entries, codes, errors)
    want = ((points[order][:, None] - entries[None]) ** 2).sum(2)
    assert (codes == want.argmin(1)).all() and (errors == want.min(1)).all()
    assert (counts == np.bincount(codes, minlength=len(entries))).all()
    assert (sums == np.stack([points[order][codes == i].sum(0) for i in range(len(entries))])).all()
    bare = codebooks.filtered(tree, entries)
    assert (bare[0] == counts).all() and (bare[1] == sums).all()
    assert compared < want.size / 2 if case != "few" else compared <= want.size


@pytest.mark.parametrize("block, leaf", [(8192, 32), (40, 3)])
def test_codes_equal_the_plain_rounds(spark, block, leaf):
    how = codebooks.Coding(parts=4, entries=6, rounds=3, block=block, leaf=leaf)
    rows = rows_of(random.Random(block), 130, dims=8) + odd(8)
    got = codebooks.compress(spark.createDataFrame(rows, SCHEMA).repartition(3), how)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain_codes(rows, how, 8)))


def test_decoded_vectors_lie_as_far_off_as_stated(spark):
    rows = rows_of(random.Random(8), 80, dims=8)
    quantiser = codebooks.Quantiser(spark.createDataFrame(rows, SCHEMA), codebooks.Coding(parts=4, entries=6, rounds=2))
    quantiser.train()
    whole = {i: v for i, v, _ in kept(rows, 8, 4096)}
    for r in quantiser.codes().collect():
        assert apart(quantiser.decoded(r["code"]), whole[r["vec_id"]]) == r["error"]


def test_integers_round_down_and_mark_what_is_too_large():
    column = pa.array([[0.5, -0.25], None, [1e30, 0.0], [1.0], [0.1, None], [-1e-9, 3.0]], pa.list_(pa.float32()))
    rows, near, values = vectors.integers(column.slice(0), 2, 10)
    assert rows.tolist() == [0, 2, 5] and near.tolist() == [True, False, True] and values.tolist() == [[5, -3], [-1, 30]]
    assert vectors.integers(column.slice(4), 2, 10)[0].tolist() == [1]
