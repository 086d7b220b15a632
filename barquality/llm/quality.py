"""Quality rules: compression bands.

Each whole text is compressed with zstandard, as one piece and in fixed chunks.
Text that compresses too well is repetitive, text that hardly compresses is
noise; both limits depend on the length, because longer texts compress better.
Chunks cover every byte: the last one ends at the end of the text (and overlaps
the one before), and a text shorter than a chunk is a chunk of its own length.
Cheap base rules (word counts and repetition) are computed in the same pass.

One narrow pass over the rows: nothing is shuffled, so neither skew nor a lost
executor costs more than the rows of a task.  A null or empty text has no words
and fails the base rules.  Very long texts are taken whole, one at a time; a
row stands for itself, so repeated rows and equal ids give repeated results; an
empty table gives an empty result; other columns are ignored (``score``) or
passed through (``keep``).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import pieces, slim, text_bytes

SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """Limits of the compression ratio (bytes before over bytes after).

    The highest ratio rises by ``per_doubling`` with each doubling of the length
    and is ``at_1024`` for 1,024 bytes; the lowest lies ``width`` below, but is 1 at
    least and ``noise`` at most.  The defaults let through all but one in a thousand of the texts
    labelled clean in a sample of 3,243, with a margin of about 0.06.  A text
    fails when more than ``chunk_share`` of its chunks are outside the limits of
    their length.
    """

    at_1024: float = 2.09
    per_doubling: float = 0.131
    width: float = 0.70
    noise: float = 1.60
    chunk_bytes: int = 1024
    chunk_share: float = 1 / 4
    level: int = 3

    def limits(self, n: int) -> tuple[float, float]:
        highest = self.at_1024 + self.per_doubling * math.log2(n / 1024)
        return max(1.0, min(self.noise, highest - self.width)), highest

    def chunks(self, data: bytes) -> list[bytes]:
        size = self.chunk_bytes
        found = [data[at : at + size] for at in range(0, len(data) - size + 1, size)]
        if len(data) % size:
            found.append(data[-size:])
        return found


@dataclass(frozen=True)
class BaseRules:
    least_words: int = 50
    most_repeated_percent: int = 50


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words inside windows that occur twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    grams = list(zip(*(words[i:] for i in range(window))))
    if len(set(grams)) == n:
        return 0
    count = Counter(grams)
    total, end = 0, 0
    for i, gram in enumerate(grams):
        if count[gram] > 1:
            total += i + window - max(i, end)
            end = i + window
    return total


def assess(data: bytes, bands: Bands, base: BaseRules, packer: zstandard.ZstdCompressor) -> tuple:
    words = data.split()
    joined = b"".join(words)
    continuation = len(joined) - len(joined.decode("utf-8", "surrogatepass"))
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeated = repeated_words(words)
    base_failed = len(words) < base.least_words or 100 * repeated > base.most_repeated_percent * len(words)
    ratio, out, chunks, verdict = 0.0, 0, [], False
    if data:

        def outside(part: bytes) -> tuple[float, bool]:
            r = len(part) / len(packer.compress(part))
            low, high = bands.limits(len(part))
            return r, not low <= r <= high

        ratio, bad = outside(data)
        chunks = bands.chunks(data)
        out = sum(outside(c)[1] for c in chunks) if len(data) > bands.chunk_bytes else int(bad)
        verdict = not bad and out <= bands.chunk_share * len(chunks)
    return (
        len(words),
        len(joined) - continuation,
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        base_failed,
        verdict and not base_failed,
        ratio,
        len(chunks),
        out,
    )


COLUMNS = {
    "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(),
    "base_failed": pa.bool_(), "kept": pa.bool_(), "ratio": pa.float64(), "n_chunks": pa.int64(), "n_bad_chunks": pa.int64(),
}
_DDL = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, ratio double, n_chunks bigint, n_bad_chunks bigint"


def score(docs: DataFrame, bands: Bands = Bands(), base: BaseRules = BaseRules()) -> DataFrame:
    """doc_id and the figures and verdicts of every row of ``docs(doc_id, text)``.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept (false if the base rules or the bands reject), ratio, n_chunks and
    n_bad_chunks.
    """
    docs = slim(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=bands.level)
        for whole in batches:
            for batch in pieces(whole, "text"):
                rows = [assess(x, bands, base, packer) for x in text_bytes(batch.column("text"))]
                columns = [pa.array(x, t) for x, t in zip(zip(*rows), COLUMNS.values())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *COLUMNS])

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {_DDL}")


def keep(docs: DataFrame, bands: Bands = Bands(), base: BaseRules = BaseRules()) -> DataFrame:
    """The rows of ``docs`` that all rules keep, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=bands.level)
        for whole in batches:
            for batch in pieces(whole, "text"):
                yield batch.filter(pa.array([assess(x, bands, base, packer)[6] for x in text_bytes(batch.column("text"))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
