import hashlib

from barquality.llm import fingerprints as fp

TEXTS = ["Straße  ONE", "STRASSE one\n", "ﬁne", "FINE", "e\u0301", "É", None, "", "  ", "z" * 200_000, "odd", "x\u2003y", "X Y"]


def test_canonical_form():
    assert fp.canonical("Straße  ONE") == fp.canonical("STRASSE one\n") == "strasse one"
    assert fp.canonical("ﬁne") == fp.canonical("FINE")
    assert fp.canonical("e\u0301") == fp.canonical("É")
    assert fp.canonical("x\u2003y") == fp.canonical("X Y")


def test_rows_match_a_plain_version(docs_of):
    rows = list(zip([5, 3, 9, 1, 7, 11, 2, 4, 6, 8, 10, 12, 13], TEXTS))
    out = {r["doc_id"]: r for r in fp.fingerprints(docs_of(rows)).collect()}
    ordered = sorted(rows)
    for k, (i, t) in enumerate(ordered):
        text, following = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + following[:half]
        r = out[i]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert r["fingerprint"] == fp.fingerprint(text) and r["edited_fingerprint"] == fp.fingerprint(new)
        assert r["near_edited"] == float(fp.canonical(new) == fp.canonical(text))
        assert r["near_next"] == float(fp.canonical(following) == fp.canonical(text))
        same = [j for j, u in rows if fp.canonical(u or "") == fp.canonical(text)]
        assert (r["group_id"], r["group_size"]) == (min(same), len(same))


def test_one_row_null_ids_repeated_rows_and_empty_table(docs_of):
    one = fp.fingerprints(docs_of([(1, "abcd")])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and one["near_next"] == 1.0
    rows = fp.fingerprints(docs_of([(None, "a b"), (2, "a b"), (2, "a b"), (3, "c")])).collect()
    assert len(rows) == 4 and sum(r["group_size"] == 3 for r in rows) == 3
    assert fp.fingerprints(docs_of([])).count() == 0


def test_equal_hashes_of_different_bytes_are_told_apart(docs_of, monkeypatch):
    docs = docs_of([(1, "a"), (2, "b"), (3, "a")])
    marks = docs.selectExpr("doc_id", "'same' AS fingerprint")
    collided = docs.selectExpr("doc_id", "'same' AS fingerprint", "text AS form")

    class Docs:
        def mapInArrow(self, *_):
            return collided

    monkeypatch.setattr(fp, "slim", lambda *_: _Typed(docs, Docs()))
    out = fp.compared(docs, marks).collect()
    assert [(r["doc_id"], r["sha"]) for r in out] == [(2, hashlib.sha256(b"b").hexdigest())]


class _Typed:
    def __init__(self, docs, stand_in):
        self.dtypes, self.mapInArrow = docs.dtypes, stand_in.mapInArrow


def test_types_of_ids(spark):
    for kind, ids in (("smallint", [2, 1]), ("decimal(9,0)", [2, 1]), ("date", ["2024-01-02", "2024-01-01"])):
        docs = spark.createDataFrame([(str(i), t) for i, t in zip(ids, ("ab", "AB"))], "i string, text string").selectExpr(f"cast(i AS {kind}) AS doc_id", "text")
        out = fp.fingerprints(docs).collect()
        assert len(out) == 2 and len({r["group_id"] for r in out}) == 1 and all(r["near_next"] == 1.0 for r in out)
