import random

import duckdb
import pytest

import corpus_pipeline
from barquality.llm import mixing, ngram_join, quality
from barquality.llm.queries import ORACLES, QUERIES


def rows(seed=3):
    rng = random.Random(seed)
    en, de = "eeeettttaaaooonnniiisssrrhhllddcumfpgwybv", "nnnneeeesssrrriiiaatdduhhllgcmobwfkzpvjäöü"
    out = []
    for i in range(60):
        letters, lang = (en, "en") if i % 3 else (de, "de")
        out.append((i, " ".join("".join(rng.choices(letters, k=rng.randint(2, 8))) for _ in range(rng.randint(60, 120))), lang, f"s{i % 4}"))
    return out + [(100, out[5][1], "en", "s0"), (101, out[5][1] + " extra", "en", "s1"), (102, "la " * 200, "en", "s1"), (103, None, "en", "s2"), (104, "few words", "de", "s3")]


def test_stages_and_columns(spark, docs_of):
    docs = docs_of(rows())
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], "").cache())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "ngram_jaccard_join", "mixing", "sentencepiece"]
    assert all(d.columns == docs.columns for d in seen[1:5])
    ids = [sorted(r["doc_id"] for r in d.select("doc_id").collect()) for d in seen]
    kept = {r["doc_id"] for r in quality.score(docs).collect() if r["kept"]}
    assert ids[1] == sorted(kept) and not {102, 103, 104} & kept
    assert set(ids[2]) <= set(ids[1]) and len(ids[2]) >= 0.9 * len(ids[1]) > 40
    found = {r["doc_id"] for r in ngram_join.jaccard_components(seen[2], 5, 80).collect() if r["doc_id"] == r["component_id"]}
    assert set(ids[3]) == found and not {100, 101} & found
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(seen[3]).collect()}
    assert ids[4] == sorted(i for i, n in taken.items() for _ in range(n))
    assert ids[5] == ids[4] and all(r["round_trip"] for r in seen[5].collect())


def test_run_writes_each_stage(spark, docs_of, tmp_path):
    docs_of(rows()).drop("keys", "node").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 30 and out.columns[0] == "doc_id"


def test_empty_table(spark, docs_of):
    docs = docs_of([])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_their_sql(spark, name):
    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    got = QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(str, map(tuple, got.select(*names).collect()))) == sorted(map(str, want.fetchall()))
