import random
import zlib

import numpy as np

from pyspark.sql import functions as F

from barquality.llm import langid

PARTS = {"en": "the and ing tion er of to in", "de": "der und ung sch ein ich die ver", "fr": "les eau que ment oir par dans oui", "es": "que ado ción los por una ñas ero", "it": "che zione gli per ita oso are una"}


def text(lang, n, rng):
    parts = PARTS[lang].split()
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(n))


def corpus(langs, per=60):
    rng = random.Random(1)
    return [(i, text(lang, rng.randint(5, 80), rng), lang) for i, lang in enumerate([x for x in langs for _ in range(per)])]


def test_held_out_accuracy(docs_of):
    rows = corpus(PARTS)
    docs = docs_of(rows)
    out = langid.held_out("doc_id", 5, 0)
    model = langid.train(docs, ~out, per_language=20)
    got = docs.select("doc_id", out.alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    predicted = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    right = [predicted[i]["lang_pred"] == lang for i, _, lang in held]
    assert np.mean(right) > 0.97
    assert all(0 <= r["score"] <= 1 for r in predicted.values())


def test_predictions_depend_on_text_alone(docs_of):
    model = langid.train(docs_of(corpus(["en", "fr"])), F.lit(True))
    docs = docs_of([(1, "les eau que"), (None, "les eau que", None, None), (2, None), (3, ""), (4, "12 3 ! §"), (5, "the and " * 60000)])
    rows = {(r["doc_id"]): tuple(r)[1:] for r in langid.predict(docs, model).collect()}
    assert rows[1] == rows[None] and rows[1][0] == "fr" and rows[5][0] == "en"
    assert rows[2] == rows[3] == rows[4] == ("und", 0.0, True)
    assert langid.predict(docs_of([]), model).count() == 0
    kept = langid.confident(docs, model)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 5]


def test_without_labels_everything_is_unknown(docs_of):
    docs = docs_of([(1, "the and", None), (2, "ing", None)])
    model = langid.train(docs, F.lit(True))
    assert {r["lang_pred"] for r in langid.predict(docs, model).collect()} == {"und"}


def test_one_language_and_mixed_texts(docs_of):
    one = langid.train(docs_of(corpus(["en"])), F.lit(True))
    assert one.decide("anything")[:2] == ("en", 1.0)
    model = langid.train(docs_of(corpus(["en", "de", "fr"])), F.lit(True))
    rng = random.Random(3)
    mixed = text("en", 100, rng) + " " + text("de", 100, rng)
    clear = model.decide(text("en", 100, rng))
    assert clear[0] == "en" and not clear[2] and model.decide(mixed)[1] < clear[1]


def test_codewords_are_apart():
    for n in (2, 3, 4, 7, 12, 40):
        code = langid.codewords(n)
        far = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        assert far >= (1 if n == 2 else 2) and (np.abs(code.sum(0)) < n).all()


def test_a_repeated_row_is_one_of_the_sample_and_null_ids_are_not_held_out(spark, docs_of):
    rows = [(1, "the same text of one row")] * 300 + [(i, f"another text number {i} of many") for i in range(2, 40)] + [(None, "kein Wort", "de")]
    docs = docs_of(rows)
    seen = []
    real = langid.fit
    langid.fit = lambda langs, feature, n: (seen.append(dict(zip(langs, [0] * len(langs)))), real(langs, feature, n))[1]
    try:
        langid.train(docs, ~langid.held_out("doc_id", 5, 0), per_language=50)
    finally:
        langid.fit = real
    assert set(seen[0]) == {"en", "de"}
    once = langid.train(docs.distinct(), ~langid.held_out("doc_id", 5, 0), per_language=50)
    again = langid.train(docs, ~langid.held_out("doc_id", 5, 0), per_language=50)
    assert (once.weights == again.weights).all()
    assert docs.where("doc_id is null").select(langid.held_out("doc_id", 5, 0)).first()[0] is False
