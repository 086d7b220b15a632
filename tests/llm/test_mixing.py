import random

import pytest

from barquality.llm import mixing


def targets(sizes, weights=(1, 2, 3), epochs=3):
    """Water-filling by hand: clamp and share again until nothing is above its clamp."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = {n: w[n] for n in names if n not in fixed}
        left = total - sum(fixed.values())
        share = {n: left * v / sum(rest.values()) for n, v in rest.items()} if rest else {}
        over = [n for n, t in share.items() if t > epochs * sizes[n]]
        if not over:
            return {**fixed, **share}
        fixed |= {n: float(epochs * sizes[n]) for n in over}


def some_docs(seed, sources):
    rng = random.Random(seed)
    rows, i = [], 0
    for name, n in sources.items():
        for _ in range(n):
            rows.append((i, " ".join(["w"] * rng.randint(1, 60)), "en", name))
            i += 1
    return rows


@pytest.mark.parametrize("sources", [{"a": 300, "b": 3, "c": 40, None: 10}, {"z": 5}, {"é": 50, "z": 50, "Z": 200, "": 7}])
def test_targets_and_taken_words(docs_of, sources):
    rows = some_docs(4, sources)
    out = mixing.mix(docs_of(rows)).collect()
    sizes = {}
    for r in out:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    expected = targets(sizes)
    taken = {}
    for r in out:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(expected[r["source"]])
        assert r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for name, t in expected.items():
        assert abs(taken[name] - t) <= 60
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.mix(docs_of(rows)).collect()), key=str)


def test_repeat_gives_rows_as_often_as_taken(docs_of):
    rows = some_docs(9, {"a": 60, "b": 4})
    docs = docs_of(rows)
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(docs).collect()}
    out = mixing.repeat(docs)
    assert out.columns == docs.columns
    count = {}
    for r in out.collect():
        count[r["doc_id"]] = count.get(r["doc_id"], 0) + 1
    assert count == {k: v for k, v in taken.items() if v}


def test_nulls_empty_texts_and_empty_tables(docs_of):
    out = {r["doc_id"]: r for r in mixing.mix(docs_of([(1, None, "en", "a"), (2, " ", "en", "b"), (3, "x y", "en", None)])).collect()}
    assert out[1]["size"] == out[1]["taken"] == out[2]["taken"] == 0 and out[1]["target"] == 0.0
    assert out[3]["target"] == 2.0 and out[3]["taken"] == 2
    assert mixing.mix(docs_of([])).count() == 0
    assert mixing.repeat(docs_of([(1, None), (2, "")])).count() == 0


def test_repeated_ids_and_clashing_names(spark):
    """Rows of one id have their own counts; names of inner columns may occur in the table."""
    schema = "doc_id long, text string, source string, _id string, _times int, _copy string, doc string, tie int, n int"
    text = lambda i: " ".join(["w"] * (1 + i % 7))
    rows = [(i // 3 if i % 11 else None, text(i), "ab"[i % 5 == 0], f"x{i % 2}", i % 2, None, "d", 1, 2) for i in range(120)]
    docs = spark.createDataFrame(rows, schema)
    out = mixing.repeat(docs)
    assert out.columns == docs.columns
    got = sorted(map(str, map(tuple, out.collect())))
    assert got == sorted(map(str, map(tuple, mixing.repeat(docs.repartition(3)).collect())))
    words = {}
    for r in out.collect():
        words[r["source"]] = words.get(r["source"], 0) + len(r["text"].split())
    want = {r["source"]: r["target"] for r in mixing.mix(docs).collect()}
    assert all(abs(words[s] - t) <= 7 for s, t in want.items())
    times = {}
    for row in got:
        times[row] = times.get(row, 0) + 1
    assert set(times) <= {str(r) for r in rows}


def test_equal_rows_share_what_is_taken(spark):
    docs = spark.createDataFrame([(1, "a b", "s")] * 5 + [(2, "c", "t")] * 3, "doc_id long, text string, source string")
    taken = mixing.mix(docs)
    want = {r["doc_id"]: r["n"] for r in taken.groupBy("doc_id").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "n").collect()}
    got = {r["doc_id"]: r["count"] for r in mixing.repeat(docs).groupBy("doc_id").count().collect()}
    assert {1: 2 * got[1], 2: got[2]} == want
