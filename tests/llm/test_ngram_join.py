import random

import numpy as np
import pytest

from barquality.llm import components, ngram_join


def shingles(text, words):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < words else frozenset(zip(*(w[i:] for i in range(words))))


def brute(rows, words, percent):
    """Components over all pairs."""
    sets = [(i, shingles(t, words)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            both = len(s & t)
            if s and t and 100 * both >= percent * (len(s) + len(t) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def families(seed, words=120, groups=12, copies=14):
    """Groups of copies with one to many edits, chains, exact copies and strangers."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(4000)]
    rows = []
    for g in range(groups):
        base = rng.choices(vocabulary, k=rng.randint(4, words))
        for c in range(copies):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append(" ".join(text))
        for _ in range(5):  # a chain, each a step from the one before
            base = list(base)
            base[rng.randrange(len(base))] = rng.choice(vocabulary)
            rows.append(" ".join(base).upper())
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("words,percent,seed", [(3, 90, 1), (5, 80, 2), (3, 80, 3)])
def test_components_match_brute_force(docs_of, words, percent, seed):
    rows = families(seed) + [(9000, None), (9001, ""), (9002, " \n"), (9003, "one"), (9004, "ONE"), (9005, "one two"), (9006, "one two")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs_of(rows), words, percent).collect()}
    assert got == brute(rows, words, percent)


def test_a_large_group_of_near_copies_with_a_far_fringe(docs_of):
    rng = random.Random(5)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for i in range(260):
        text = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            text[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs_of(rows)).collect()}
    assert got == brute(rows, 3, 90)


def test_candidates_of_a_graded_group_stay_below_its_members(docs_of, monkeypatch):
    """Copies of one text with ever more edits, most of them beyond any link: few pairs of them are looked at."""
    rng = random.Random(11)
    base = [f"b{k}" for k in range(160)]
    rows = []
    for i in range(300):
        text = list(base)
        for at in rng.sample(range(160), i // 15):
            text[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    written, persist = {}, ngram_join.persist_table

    def noted(df, name):
        out = persist(df, name)
        written[name] = out
        return out

    monkeypatch.setattr(ngram_join, "persist_table", noted)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs_of(rows), 5, 80).collect()}
    assert got == brute(rows, 5, 80)
    assert 20 < len({c for _, c in got.values()}) < 280
    assert written["candidates"].count() < len(rows)


def test_links_between_members_that_are_far_from_every_pivot(docs_of):
    """Families whose members share a long passage: pivots of the passage link with one family at most."""
    rng = random.Random(12)
    passage, rows = [f"p{k}" for k in range(60)], []
    for g in range(30):
        own = [f"g{g}w{k}" for k in range(40)]
        for _ in range(4):
            text = passage + own
            for _ in range(rng.choice([0, 1, 2])):
                text[rng.randrange(100)] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(text)))
    rng.shuffle(rows)
    for words, percent in ((5, 80), (3, 90)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs_of(rows), words, percent).collect()}
        assert got == brute(rows, words, percent)


def test_drop_similar_keeps_one_of_each_group_and_all_columns(docs_of):
    text = " ".join(f"w{i}" for i in range(100))
    docs = docs_of([(3, text), (5, text + " end"), (7, text.upper()), (8, "other words here and there"), (9, None), (None, "a text without id")])
    out = ngram_join.drop_similar(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in out.collect()) == [0, 3, 8, 9]


def test_repeated_rows_and_empty_table(docs_of):
    rows = ngram_join.jaccard_components(docs_of([(4, "a b c d"), (4, "a b c d"), (2, "a b c d")])).collect()
    assert [(r["component_id"], r["class_size"]) for r in rows] == [(2, 3)] * 3
    assert ngram_join.jaccard_components(docs_of([])).count() == 0
    assert ngram_join.drop_similar(docs_of([])).count() == 0


def test_sketch_words_that_differ_are_at_most_the_symmetric_difference():
    rng = np.random.default_rng(1)
    bands = ngram_join.Bands(90, 5000)
    for n in (9, 30, 200, 1500):
        one = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        most = (2 * n) // 19
        two = np.unique(np.concatenate([one[most // 2 :], rng.integers(0, 1 << 63, most // 2, np.uint64)]))
        (a, tags), (b, other) = ngram_join.sketch_keys(one, bands), ngram_join.sketch_keys(two, bands)
        low = (1 << ngram_join.TAG_BITS) - 1
        shared = set(a.tolist()) & set(b.tolist())
        assert len(shared) >= min(tags.min() & low, other.min() & low) > 0


def test_components_of_chains_stars_loops_and_nulls(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    out = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert out == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_parity_bits_differ_at_most_as_much_as_the_sets():
    rng = np.random.default_rng(4)
    for n in (5, 100, 3000):
        one = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        two = np.unique(np.concatenate([one[n // 10 :], rng.integers(0, 1 << 63, n // 8, np.uint64)]))
        a, b = ngram_join.parity_bits(one), ngram_join.parity_bits(two)
        assert len(a) == ngram_join.SKETCH_BITS // 64
        assert int(np.bitwise_count(a ^ b).sum()) <= len(np.setxor1d(one, two))


def test_drop_similar_with_clashing_names_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(4, text, "a"), (4, text, "b"), (6, text + " x", "c"), (None, "some other words of their own", "d"), (None, None, "e"), (9, "short", "f")]
    docs = spark.createDataFrame([(i, t, 1, 2, 3, 4, x, 5) for i, t, x in rows], "doc_id long, text string, _word int, _bits int, _maybe int, _hit int, hit string, at int")
    out = ngram_join.drop_similar(docs)
    assert out.columns == docs.columns
    assert sorted(r["hit"] for r in out.collect()) == ["a", "b", "d", "e", "f"]
    ids = [(r["doc_id"], r["component_id"], r["n_links"]) for r in ngram_join.jaccard_components(docs, 5, 80).collect()]
    assert sorted(map(str, ids)) == sorted(map(str, [(4, 4, 1), (4, 4, 1), (6, 4, 1), (None, None, 0), (None, None, 0), (9, 9, 0)]))
