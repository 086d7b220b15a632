import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barquality.llm import langid, lm


def some(n, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.6))}" for _ in range(3000)]
    return [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60))).capitalize()) for i in range(n)]


def lowered(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "").encode().split() + [None]


def train_rows(rows):
    return [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]


def test_base_score_and_counts_are_exact(docs_of):
    rows = some(300) + [(900, None), (901, ""), (902, "Unseen words only éÉ"), (903, "w1 " * 20000)]
    docs = docs_of(rows)
    out = langid.held_out("doc_id", 7, 2)
    got = {r["doc_id"]: r for r in lm.score(docs, lm.train(docs, ~out), out).collect()}
    count = Counter(w for t in train_rows(rows) for w in lowered(t))
    total, types = sum(count.values()), len(count)
    for i, t in rows:
        words = lowered(t)
        r = got[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(count[w] > 0 for w in words), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (total + types + 1)) for w in words))
        assert r["score"] < 0


def test_bigrams_help_where_the_order_of_words_is_fixed(docs_of):
    rng = random.Random(2)
    chain = [f"c{i}" for i in range(200)]
    rows = []
    for i in range(400):
        at = rng.randrange(170)
        rows.append((i, " ".join(chain[at : at + 30])))
    docs = docs_of(rows)
    out = langid.held_out("doc_id", 7, 2)
    held = [r for r in lm.score(docs, lm.train(docs, ~out), out).collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.5 * sum(r["base_score"] for r in held)


def test_codes_come_back_from_the_filter():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 5000, np.uint64) * np.uint64(2))
    codes = lm.code_of(np.maximum(1, rng.geometric(0.05, len(keys)) ** rng.integers(1, 4, len(keys))))
    f = lm.Filter(lm.entries(codes))
    assert f.bits >= lm.BITS_PER_ENTRY * lm.entries(codes)
    f.words = np.packbits(f.block(keys, codes, 0), bitorder="little").view(np.uint64)
    found = f.codes(keys, 0)
    assert (found >> lm.MANTISSA >= codes >> lm.MANTISSA).all() and (found == codes).mean() > 0.99
    assert (f.codes(rng.integers(0, 1 << 63, 50_000, np.uint64), 0) > 0).mean() < 0.0012
    assert (f.codes(keys, 1) > 0).mean() < 0.0025


def test_values_of_codes():
    small = np.arange(2 << lm.MANTISSA)
    assert (lm.VALUE[lm.code_of(small)] == small).all()
    large = np.unique(np.random.default_rng(2).integers(1, 1 << 40, 5000))
    assert np.abs(lm.VALUE[lm.code_of(large)] / large - 1).max() <= 0.004
    assert (np.diff(lm.code_of(np.arange(100_000))) >= 0).all()


def test_no_training_texts_and_empty_table(docs_of):
    docs = docs_of([(1, "a b")])
    out = langid.held_out("doc_id", 7, 99)
    model = lm.train(docs, out)
    row = lm.score(docs, model, ~out).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (3, 0, 0, 0.0)
    assert lm.score(docs_of([]), model, ~out).count() == 0


def plain_model(texts):
    """Counts of tokens and bigrams, with None as the end and 0 as the start."""
    tokens, pairs = Counter(), Counter()
    for t in texts:
        words = lowered(t)
        tokens.update(words)
        pairs.update(zip([0, *words], words))
    return tokens, pairs


def value(n):
    return float(lm.VALUE[lm.code_of(np.array([n]))[0]])


def reader(model):
    """Codes of hashes, read from the blocks of a model one by one."""
    blocks = {r["seg"]: r["body"] for r in model.blocks.collect()}
    assert len(blocks) > 1

    def codes(found, kind):
        seg, out = lm._segment(found, model.segments), np.zeros(len(found), np.int64)
        for s, body in blocks.items():
            n = int.from_bytes(body[:8], "little")
            out[seg == s] = lm.Filter(words=np.frombuffer(body[8 + 16 * n :], np.uint64)).codes(found[seg == s], kind)
        return out

    return codes


def bigram_hash(context, tokens):
    return lm.mix64(np.full(len(tokens), context) * np.uint64(0x9E3779B97F4A7C15) + lm.mix64(tokens))


def test_scores_match_a_plain_model(docs_of):
    """Token by token from the codes in the filter, of which all but a few are those of the counts."""
    rows = some(400, 8) + [(900, None), (901, ""), (902, "Unseen words only éÉ"), (903, "w1 " * 3000), (903, "w1 w2")]
    docs = docs_of(rows)
    out = langid.held_out("doc_id", 7, 2)
    model = lm.train(docs, ~out)
    tokens, pairs = plain_model(train_rows(rows))
    codes, hashes = reader(model), lm.Tokens()
    key = lambda w: lm.START if w == 0 else lm.END if w is None else np.uint64(hashes([w])[0][0])
    words = {w for _, t in rows for w in lowered(t)}
    read = lambda h, kind: lm.VALUE[codes(np.array(h, np.uint64), kind)].tolist()
    of_token = dict(zip(words, read([key(w) for w in words], 0)))
    met = list({p for _, t in rows for p in zip([0, *lowered(t)], lowered(t))})
    of_pair = dict(zip(met, read([bigram_hash(key(c), np.array([key(w)]))[0] for c, w in met], 1)))
    assert sum(of_pair[p] != value(pairs[p]) for p in met) < 0.005 * len(met) and sum(of_token[w] != value(tokens[w]) for w in words) < 0.02 * len(words)
    space = sum(map(value, tokens.values())) + len(tokens) + 1

    def log10(text):
        total = 0.0
        for c, w in zip([0, *lowered(text)], lowered(text)):
            before = model.texts if c == 0 else of_token[c]
            weight = model.weights[int(before).bit_length()]
            seen = of_pair[c, w] / before if before else 0.0
            total += math.log10(weight * min(seen, 1.0) + (1 - weight) * (of_token[w] + 1) / space)
        return total

    got = sorted((r["doc_id"], r["score"]) for r in lm.score(docs, model, out).collect())
    for g, w in zip(got, sorted((i, log10(t)) for i, t in rows)):
        assert g[0] == w[0] and g[1] == pytest.approx(w[1], abs=1e-6)


def test_probabilities_add_up_to_one(docs_of):
    """Over the whole vocabulary and one unknown word, for 200 contexts with and without counts, read from the filter."""
    rng = random.Random(6)
    words = [f"v{i}" for i in range(500)]
    rows = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(500)], k=rng.randint(1, 120)))) for i in range(900)] + [(1000 + i, "v0 v1 " * 300) for i in range(9)]
    docs = docs_of(rows)
    model = lm.train(docs, F.lit(True))
    tokens, pairs = plain_model(t for _, t in rows)
    hashes = lm.Tokens()
    types = list(tokens)
    keys = {w: hashes([w])[0][0] if w else lm.END for w in types}
    vocabulary = np.array([keys[w] for w in types], np.uint64)
    codes = reader(model)
    contexts = [0, *[w for w, _ in tokens.most_common() if w][:150], *(f"unseen{i}" for i in range(50))]
    false = 0
    for c in contexts:
        h = lm.START if c == 0 else keys.get(c.encode() if isinstance(c, str) else c, hashes([c.encode() if isinstance(c, str) else c])[0][0])
        pair = codes(bigram_hash(h, vocabulary), 1)
        seen = np.array([pairs[c, w] > 0 for w in types])
        false += int((pair[~seen] > 0).sum())
        context = -1 if c == 0 else int(codes(np.array([h]), 0)[0])
        octave, bigram, unigram = lm.estimates(model, np.full(len(types), context), codes(vocabulary, 0), np.where(seen, pair, 0))
        weight = model.weights[octave]
        unknown = (1 - weight[0]) / (model.value + model.types + 1)
        assert 0.99 < (weight * bigram + (1 - weight) * unigram).sum() + unknown < 1.01, c
    assert false < 0.002 * len(contexts) * len(types)


def test_one_lookup_gives_the_scores_of_two(docs_of, monkeypatch):
    monkeypatch.setattr(lm, "ASKING", 4000)
    docs = docs_of(some(300) + [(900, None), (901, ""), (901, "w1 w2"), (903, "w1 " * 20000)])
    out = langid.held_out("doc_id", 7, 2)
    rows = [sorted(map(str, d.collect())) for d in (lm.score(docs, lm.train(docs, ~out), out), lm.train_and_score(docs, ~out, out))]
    assert rows[0] == rows[1] and len(rows[0]) == 304


def test_bigrams_seen_once_count(docs_of):
    """Words that are all equally rare: only the bigram, seen once, tells a text of the training set from its reverse."""
    words = [f"u{i}" for i in range(400)]
    docs = docs_of([(i, " ".join(words[i * 20 : i * 20 + 20])) for i in range(20)])
    model = lm.train(docs, langid.held_out("doc_id", 7, 99) == False)  # noqa: E712
    # the weights are set: leaving one out takes all weight from what is seen once
    model = lm.Trained(**{**model.__dict__, "weights": np.full(lm._OCTAVES, 0.5)})
    both = docs_of([(1, " ".join(words[:20])), (2, " ".join(words[19::-1]))])
    got = {r["doc_id"]: r["score"] for r in lm.score(both, model, langid.held_out("doc_id", 7, 99)).collect()}
    assert got[1] > got[2] + 15 * math.log10(50)


def test_weights_are_fitted_on_every_training_text(docs_of):
    """The one text that reaches a high level is the last in the order of hashes."""
    ids = docs_of([(i, "") for i in range(1200)]).orderBy(F.xxhash64("doc_id").desc()).limit(1)
    last = ids.first()["doc_id"]
    docs = docs_of([(i, "z " * 5000 if i == last else f"a{i % 7} b") for i in range(1200)])
    weights = lm.train(docs, F.lit(True)).weights
    assert weights[(5000).bit_length()] == lm.GRID[-1]
    assert weights[0] == 0
