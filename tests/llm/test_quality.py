import math
import random
import re
from collections import Counter

import pytest
import zstandard

from barquality.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    """The base figures, word by word."""
    text = text or ""
    w = WORD.findall(text)
    count = Counter(zip(w, w[1:], w[2:]))
    covered = {k + j for k in range(len(w) - 2) if count[tuple(w[k : k + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def prose(n, seed=1):
    rng = random.Random(seed)
    letters = "eeeeettttaaaoooiinnsshhrrddllcumwfgypbvk"
    return " ".join("".join(rng.choices(letters, k=rng.randint(2, 8))) for _ in range(n)) if n > 300 else _sentence(rng, n)


def _sentence(rng, n):
    parts = "the of an er in ti on ed re ou st ha nd th en at or le be ly ing ble tion with from this".split()
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n))


CASES = [None, "", " \t\n", "one", "a b c a b c a b c", "x\ny\nx\n\n\nx", "é à\u00a0b\u2003c \x1c d", "# $ & é|<> *", prose(200), prose(60) + "\n" + prose(60), "la " * 500, prose(30000)]


def test_base_figures_match_a_plain_version(docs_of):
    rows = {r["doc_id"]: r for r in quality.score(docs_of(list(enumerate(CASES)))).collect()}
    for i, text in enumerate(CASES):
        r = rows[i]
        got = r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]
        assert got == plain(text), i
        assert not (r["base_failed"] and r["kept"])


def test_bands_keep_prose_and_reject_noise_and_repetition(docs_of):
    rng = random.Random(3)
    noise = " ".join("".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(6)) for _ in range(400))
    line = prose(40, 9)
    near = "\n".join(line + f" {i}" for i in range(80))
    texts = [prose(n, n) for n in (60, 100, 300, 1000, 5000, 20000)] + [noise, near]
    kept = {r["doc_id"]: r["kept"] for r in quality.score(docs_of(list(enumerate(texts)))).collect()}
    assert all(kept[i] for i in range(6)) and not kept[6] and not kept[7]


def test_keep_passes_all_columns_and_repeated_rows(docs_of):
    docs = docs_of([(1, prose(100)), (1, prose(100)), (None, prose(90)), (2, "short"), (3, None)])
    out = quality.keep(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in out.collect()) == [0, 1, 1]


def test_empty_table(docs_of):
    assert quality.score(docs_of([])).count() == 0
    assert quality.keep(docs_of([])).count() == 0


@pytest.mark.parametrize("words,expected", [([b"a"] * 2, 0), ([b"a"] * 4, 4), ([b"a", b"b", b"c", b"x", b"a", b"b", b"c"], 6)])
def test_repeated_words(words, expected):
    assert quality.repeated_words(words) == expected


def plain_verdict(text, at_1024=2.09, per_doubling=0.131, width=0.70, size=1024):
    """ratio, chunks, chunks outside, kept: every chunk by its first byte."""
    data = (text or "").encode()
    if not data:
        return 0.0, 0, 0, False

    def ratio(part):
        return len(part) / len(zstandard.ZstdCompressor(level=3).compress(part))

    def outside(part):
        high = at_1024 + per_doubling * (math.log(len(part)) - math.log(1024)) / math.log(2)
        return not max(1.0, min(1.6, high - width)) <= ratio(part) <= high

    starts = [0] if len(data) <= size else [*range(0, len(data) - size + 1, size)]
    if len(data) > size and starts[-1] + size < len(data):
        starts.append(len(data) - size)
    bad = sum(outside(data[a : a + size]) for a in starts)
    return ratio(data), len(starts), bad, not plain(text)[5] and not outside(data) and 4 * bad <= len(starts)


def test_verdicts_match_a_plain_version(docs_of):
    rng = random.Random(7)
    noise = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ+/", k=3000))
    cases = CASES + [prose(n, n) for n in (55, 120, 160, 200, 260, 300)] + [prose(150, 2) + " $ %" * 90, prose(150, 3) + noise[:900], noise, prose(250, 4)[:1024], prose(250, 4)[:1025], prose(450, 5)[:2048]]
    rows = {r["doc_id"]: r for r in quality.score(docs_of(list(enumerate(cases)))).collect()}
    for i, text in enumerate(cases):
        want = plain_verdict(text)
        assert rows[i]["ratio"] == pytest.approx(want[0]) and (rows[i]["n_chunks"], rows[i]["n_bad_chunks"], rows[i]["kept"]) == want[1:], i


def test_the_tail_is_judged(docs_of):
    """What lies behind the last full chunk counts, noise and repetition alike."""
    start = prose(200, 6)[:1024]
    tails = {1: prose(200, 8)[:700], 2: "ab " * 233, 3: "$ | " * 175}
    bad = {r["doc_id"]: r["n_bad_chunks"] for r in quality.score(docs_of([(i, start + t) for i, t in tails.items()])).collect()}
    assert bad == {1: 0, 2: 1, 3: 1}
