"""The set join against every block of every text, word by word."""

import random
import re

import duckdb
import pytest

from barquality.llm import licenses, oracles
from barquality.llm.licenses import Template

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_blocks(ws, templates, percent):
    met = set()
    for t, template in enumerate(templates):
        own = words(template.text)
        want, step = set(own), 1
        while step < max(len(own), 2):
            step *= 2
        for first in range(0, len(ws), step):
            shared = len(want & set(ws[first : first + 2 * step]))
            if 100 * shared >= percent * len(want):
                met.add((t, first, step, shared, len(want)))
    return met


def plain(text, templates=licenses.TEMPLATES, percent=licenses.PERCENT):
    ws = words(text)
    found = plain_blocks(ws, templates, percent)
    sets = [set(words(t.text)) for t in templates]
    left = [
        a for a in found
        if not any(sets[a[0]] < sets[b[0]] and templates[a[0]].label != templates[b[0]].label and b[1] < a[1] + 2 * a[2] and a[1] < b[1] + 2 * b[2] for b in found)
    ]
    places = [(i, p.label) for p in licenses.PHRASES for own in [words(p.text)] for i in range(len(ws)) if ws[i : i + len(own)] == own]
    base = {label for _, label in places}
    at = [i for i, _ in places]
    labels = base | {templates[t].label for t, *_ in left}
    return len(ws), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), max((s / n for *_, s, n in left), default=0.0), len(left)


def noisy(rng):
    """Template texts with words lost, swapped and added, between words of no license and of all."""
    pool = [w for t in licenses.TEMPLATES for w in words(t.text)]
    out = []
    for _ in range(rng.randint(0, 5)):
        ws = words(rng.choice(licenses.TEMPLATES + licenses.PHRASES).text)
        ws = [w for w in ws if rng.random() > 0.05]
        if rng.random() < 0.3:
            rng.shuffle(ws)
        out += [*ws, *rng.choices(pool + ["ünder", "foo", "ライ"], k=rng.randint(0, 30))]
    return rng.choice([" ", ", ", "\n", "-"]).join(w.upper() if rng.random() < 0.2 else w for w in out)


CASES = [
    None, "", " \n\t", "...", "Released under the MIT License.", "under\nthe\nmit... LICENSE", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.", "apache license version 2 apache license version 2",
    "This work is licensed under the GNU General Public License, version 3.", "GNU Lesser General Public License", "GNU Affero General Public License version 3", "under the mit licénse", "mit license the under", "license " * 3000,
    "word " * 5000 + "gnu general public license " + "word " * 5000, "cc by", "nc cc by nc by", "À L'ÉCOLE ÜNDER THE MIT", "under the\x00mit\x7flicense",
]


@pytest.mark.parametrize("ordered", [True, False])
def test_scan_equals_the_plain_version(spark, docs_of, ordered):
    rng = random.Random(5)
    texts = CASES + [noisy(rng) for _ in range(150)] + CASES[4:6]
    docs = docs_of(list(enumerate(texts))).repartition(3)
    got = licenses.scan(docs, None if ordered else licenses.Scanner())
    assert sorted(map(tuple, got.collect())) == sorted((i, *plain(t)) for i, t in enumerate(texts))


def test_matches_are_all_blocks_that_meet_other_templates(spark, docs_of):
    rng = random.Random(6)
    pool = "a b c d e f g h i j k l m n o p".split()
    templates = tuple(Template(f"t{n}", " ".join(rng.choices(pool, k=n))) for n in (1, 2, 3, 5, 8, 13, 20))
    texts = [" ".join(rng.choices(pool, k=rng.randint(0, 70))) for _ in range(60)] + [None, ""]
    docs = docs_of(list(enumerate(texts)))
    for percent in (50, 80, 100):
        scanner = licenses.ordered_by_frequency(docs, templates, (Template("x", "a b"),), percent)
        got = {(r["doc_id"], r["template"], r["first_word"], r["shared"]) for r in licenses.matches(docs, scanner).collect()}
        want = {(i, t, first, shared) for i, text in enumerate(texts) for t, first, _, shared, _ in plain_blocks(words(text), templates, percent)}
        assert got == want and len(got) > 50


def test_words_are_ordered_by_their_counts(spark, docs_of):
    docs = docs_of([(1, "the the license"), (2, "The GNU"), (3, None)])
    scanner = licenses.ordered_by_frequency(docs)
    assert scanner.rank[b"the"] == len(scanner.words) - 1 and scanner.rank[b"mozilla"] < scanner.rank[b"gnu"] < scanner.rank[b"the"]


def test_empty_table_and_refusals(spark, docs_of):
    assert licenses.scan(docs_of([(1, "x")]).where("false")).collect() == []
    for templates in ((Template("x", "..."),), (Template("x", "a " * (licenses.MOST_WORDS + 1)),)):
        with pytest.raises(ValueError):
            licenses.Scanner(templates)


def test_sql_equals_the_plain_version(spark):
    texts = CASES + [noisy(random.Random(i)) for i in range(60)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t) for i, t in enumerate(texts) if not t or "\x00" not in t])
    want = con.execute(oracles.OP13)
    assert [d[0] for d in want.description] == ["doc_id", *(x.split()[0] for x in licenses._SCAN.split(", "))]
    assert sorted(want.fetchall()) == sorted((i, *plain(t)) for i, t in enumerate(texts) if not t or "\x00" not in t)
