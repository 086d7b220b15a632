"""Language ID by error-correcting output codes.

Every language has a binary codeword.  For each bit a binary n-gram classifier
(log odds of hashed byte n-grams, each language weighing the same) says on
which side a text lies; the codeword with the least loss over all bits,
weighted by how well each bit's classifier separated the training texts, names
the language.  A text is ambiguous when the runner-up is almost as near.

Training reads a bounded sample: of each language the ``per_language`` labelled
different documents with the smallest hash of id and text, whole texts.  A bound
on the hash per language leaves few rows for the top-k, their n-grams are counted
where they lie and summed with partial aggregation; only the counts (languages x
``FEATURES``, for at most ``MOST_LANGUAGES`` languages) reach the driver.  Prediction
is one narrow pass.

A text that is null or has no letter is ``und`` with score 0.  With no labelled
documents everything is ``und``.  Equal texts get equal predictions, ties go to
the first language by code point.  Very long texts are scored whole, in slices.
An empty table gives an empty result; other columns are ignored or, in
``confident``, passed through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import persist_table, pieces, slim, texts_of
from .ngram_join import bit_filter

UNKNOWN = "und"
FEATURE_BITS = 15
FEATURES = 1 << FEATURE_BITS
ORDERS = (2, 3, 4)
#: More languages than this are refused; it bounds what is broadcast and collected.
MOST_LANGUAGES = 500
#: Bytes scored at a time.
SLICE = 1 << 18
_LETTER = re.compile(r"[^\W\d_]")
#: Everything in ASCII that is no letter reads as a space.
_FOLD = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def features(data: bytes) -> np.ndarray:
    """Feature numbers of all byte n-grams of folded text, one row per order."""
    raw = np.frombuffer(b"   " + data + b" ", np.uint8).astype(np.uint32)
    gram, out = raw, []
    for n in range(2, ORDERS[-1] + 1):
        gram = gram[:-1] << np.uint32(8) | raw[n - 1 :]
        if n in ORDERS:
            mixed = (gram + np.uint32(n * 0x3C6EF372 & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
            out.append(mixed >> np.uint32(32 - FEATURE_BITS))
    return np.concatenate(out).astype(np.int64)


def folded(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_FOLD).split())


def codewords(count: int, seed: int = 5) -> np.ndarray:
    """One row of +1/-1 per language: all dichotomies up to 7 languages, else a spread random code."""
    if count <= 7:
        rest = [set(c) for k in range(1, count) for c in combinations(range(1, count), k)]
        columns = [[-1 if i in s else 1 for i in range(count)] for s in rest] or [[1] * count]
        return np.array(columns).T
    bits, rng = int(12 * np.log2(count)), np.random.default_rng(seed)
    best, gap = None, -1
    for _ in range(50):
        code = rng.choice([-1, 1], (count, bits))
        far = min(int((code[i] != code[i + 1 :]).sum(1).min()) for i in range(count - 1))
        if far > gap and (np.abs(code.sum(0)) < count).all():
            best, gap = code, far
    return best


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # features x bits
    trust: np.ndarray  # per bit
    near: float = 0.12

    def margins(self, data: bytes) -> np.ndarray:
        """The mean log odds of each bit over all n-grams."""
        total, n = np.zeros(self.code.shape[1]), 0
        for at in range(0, max(len(data), 1), SLICE):
            f = features(data[at : at + SLICE])
            total += np.bincount(f, minlength=FEATURES) @ self.weights if len(f) > FEATURES else self.weights.take(f, axis=0).sum(0)
            n += len(f)
        return total / max(n, 1)

    def decide(self, text: str) -> tuple[str, float, bool]:
        """language, score, ambiguous."""
        if not self.languages or not _LETTER.search(text):
            return UNKNOWN, 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        loss = (np.exp(-np.clip(self.code * self.margins(folded(text)), -20, 20)) * self.trust).sum(1) / self.trust.sum()
        first, second = np.argsort(loss, kind="stable")[:2]
        odds = np.exp(-(loss - loss[first]) * 3)
        return self.languages[first], float(1 / odds.sum()), bool(loss[second] - loss[first] < self.near * loss[second])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, feature, n over the rows of a task."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch.column("text"))):
            data = folded(text)
            into = counts.setdefault(lang, np.zeros(FEATURES, np.int64))
            for at in range(0, max(len(data), 1), SLICE):
                into += np.bincount(features(data[at : at + SLICE]), minlength=FEATURES)
    for lang, n in counts.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "feature", "n"])


def train(docs: DataFrame, usable: Column, per_language: int = 1000) -> Model:
    """Fit on ``docs(doc_id, text, lang)`` where ``usable`` holds and lang is not null."""
    labelled = slim(docs.where(usable & F.col("lang").isNotNull()), "doc_id", "lang", "text").withColumn("place", F.xxhash64("doc_id", "text"))
    low = F.col("place").bitwiseAND(0xFFFFFFFF)
    # hashes below a bound that lets about three times as many through, so the top-k sorts few rows
    counts = persist_table(labelled.groupBy("lang").agg(F.approx_count_distinct("place").alias("n")).limit(MOST_LANGUAGES + 1), "languages")
    if counts.count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    bounds = counts.select("lang", (3.0 * per_language / F.col("n") + 100.0 / F.col("n")).alias("share"))
    few = labelled.select("lang", "place").join(F.broadcast(bounds), "lang").where(low < F.col("share") * float(1 << 32)).select("lang", "place").distinct()
    first = Window.partitionBy("lang").orderBy(low, "place")
    chosen = few.withColumn("at", F.row_number().over(first)).where(F.col("at") <= per_language)
    chosen = persist_table(chosen.select("lang", "place"), "sample")
    # a row that is repeated counts once
    rows = bit_filter(labelled, chosen.select("place"), "place").join(F.broadcast(chosen), ["lang", "place"], "left_semi").dropDuplicates(["lang", "place"])
    counts = rows.select("lang", "text").mapInArrow(_counted, "lang string, feature bigint, n bigint")
    table = counts.groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    return fit(table["lang"].to_numpy(), table["feature"].to_numpy(), table["n"].to_numpy())


def fit(langs: np.ndarray, feature: np.ndarray, n: np.ndarray) -> Model:
    names = tuple(sorted({str(x) for x in langs}, key=str.encode))
    if not names:
        return Model((), np.zeros((0, 0)), np.zeros((FEATURES, 0)), np.zeros(0))
    counts = np.zeros((len(names), FEATURES))
    np.add.at(counts, (np.searchsorted(np.array(names), langs.astype(str)) if len(names) > 1 else np.zeros(len(langs), int), feature), n)
    share = (counts + 0.05) / (counts + 0.05).sum(1, keepdims=True)
    code = codewords(len(names))
    weights = np.empty((FEATURES, code.shape[1]))
    for bit in range(code.shape[1]):
        up, down = share[code[:, bit] > 0], share[code[:, bit] < 0]
        weights[:, bit] = np.log(up.mean(0)) - np.log(down.mean(0)) if len(down) else 0.0
    # a bit is trusted by the mean margin with which it separates each language's own n-grams
    own = (share @ weights) * code
    trust = np.clip(own.min(0), 0.01, None)
    return Model(names, code, weights.astype(np.float32), trust)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous of every row of ``docs(doc_id, text)``."""
    docs = slim(docs, "doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                rows = [shared.value.decide(t) for t in texts_of(batch.column("text"))]
                columns = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.float64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double, ambiguous boolean")


def confident(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose text has a language that is not ambiguous, with all columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                yield batch.filter(pa.array([not shared.value.decide(t)[2] for t in texts_of(batch.column("text"))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(column: str, parts: int, left: int) -> Column:
    """crc32 of the id as text, modulo ``parts``, is ``left``; false for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % parts == left, F.lit(False))
