"""LM scoring with a log-frequency Bloom filter.

Tokens are lower-cased words and one end per text.  Token and bigram counts
cover every training text: tasks combine what they read and send packed arrays
of (hash, count) to segments of the hash space, where they are merged.

Counts are quantised on a log scale: the octave of a count and ``MANTISSA`` more
bits, so counts below 2^(MANTISSA+1) are exact and larger ones within 0.4%.  An
n-gram enters the filter once per octave up to its own and once per set bit.  A
segment of the hash space owns a block of the filter with ``BITS_PER_ENTRY`` bits
for each of its entries, whatever the size of the input: the filter is never in
one place.  Batches of texts send their distinct n-grams to the segments, and
the codes come back to the batch, where they are laid along its tokens.  A code
is read by probing membership of one octave after the other until one is
absent, then of the bits below it; ``PROBES`` probes at this density answer for an
absent entry in 6 of 10,000 cases.

The probability of a word is an interpolation, with a weight that depends on the
octave of the context's count and is fitted by leaving one out on all training
texts:

    w * v(context, word) / v(context) + (1 - w) * (v(word) + 1) / (sum of v + types + 1)

with v the quantised counts.  As the counts of a context's bigrams add up to its
own, and both parts of that fraction are within 0.4%, the words of the vocabulary
and one unknown word have a probability of 1 in sum, within 1%, up to false
positives of the filter.  An unseen context has weight 0.

Beside it stands an exact add-one unigram score from the merged counts, which the
segments answer together with the codes.

A null text is empty: it has the end token alone.  Very long texts are scored
whole, repeated rows each on their own; extra columns are ignored; an empty
table gives an empty result; without training texts every token is unknown.
Tokens are known by a 64-bit hash.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, persist_table, pieces, slim, text_bytes

#: Bits of a count below its highest.
MANTISSA = 7
BITS_PER_ENTRY = 16
PROBES = 8
#: Words of which a worker keeps the hash.
KNOWN_WORDS = 250_000
#: N-grams that a task combines before it sends them on.
COMBINED = 1_500_000
#: All texts are looked up, in so many rounds one after the other, each with its share of them: shuffles of one round are on disk at a time.
ROUNDS = 2
#: Bytes of the texts that ask for their n-grams together.
ASKING = 8 << 20
END = np.uint64(xxhash.xxh3_64_intdigest(b" end"))
START = np.uint64(xxhash.xxh3_64_intdigest(b" start"))
_OCTAVES = 48
GRID = np.array([0.0, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95])


def code_of(counts: np.ndarray) -> np.ndarray:
    """Octave + 1 of each count, and the bits below its highest; 0 for 0."""
    counts = np.asarray(counts, np.int64)
    octave = np.frexp(counts.astype(float))[1].astype(np.int64) - 1
    bits = (counts << MANTISSA >> np.maximum(octave, 0)) - (1 << MANTISSA)
    return np.where(counts > 0, (octave + 1 << MANTISSA) | bits, 0)


def _code_values() -> np.ndarray:
    """The mean of the counts of each code."""
    code = np.arange(_OCTAVES << MANTISSA)
    step = 2.0 ** ((code >> MANTISSA) - 1 - MANTISSA)
    low = ((1 << MANTISSA) + (code & (1 << MANTISSA) - 1)) * step
    value = (np.ceil(low) + np.maximum(np.ceil(low + step) - 1, np.ceil(low))) / 2
    return np.where(code >> MANTISSA, value, 0.0)


VALUE = _code_values()


class Tokens:
    """Hashes of the tokens of several texts, laid end to end; words seen before keep their hash."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """token hashes (each text followed by END) and the number of tokens of each text."""
        words: list[bytes] = []
        lengths = np.empty(len(texts), np.int64)
        for i, t in enumerate(texts):
            w = t.lower().split()
            words += w
            words.append(b"")
            lengths[i] = len(w) + 1
        known = self.known
        if len(known) > KNOWN_WORDS:
            known.clear()
        new = set(words).difference(known)
        known.update((w, xxhash.xxh3_64_intdigest(w) if w else int(END)) for w in new)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), lengths


def bigrams(tokens: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The context of each token and the hash of the bigram."""
    context = np.empty_like(tokens)
    context[1:] = tokens[:-1]
    context[np.cumsum(lengths) - lengths] = START
    return context, mix64(context * np.uint64(0x9E3779B97F4A7C15) + mix64(tokens))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def _segment(keys: np.ndarray, segments: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)


_PACKED = "seg int, kind int, keys binary, counts binary"


def _packed(kind: int, keys: np.ndarray, counts: np.ndarray, segments: int) -> pa.RecordBatch:
    """One row per segment; keys are sorted, so segments are runs."""
    seg = _segment(keys, segments)
    edges = np.searchsorted(seg, np.arange(segments + 1))
    full = [s for s in range(segments) if edges[s] < edges[s + 1]]
    cut = [slice(edges[s], edges[s + 1]) for s in full]
    return pa.RecordBatch.from_arrays(
        [pa.array(full, pa.int32()), pa.array([kind] * len(full), pa.int32()), pa.array([keys[c].tobytes() for c in cut], pa.binary()), pa.array([counts[c].astype(np.uint32).tobytes() for c in cut], pa.binary())],
        ["seg", "kind", "keys", "counts"],
    )


def _count_rows(segments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held = Tokens(), {0: [], 1: []}
        size = 0
        for whole in batches:
            for batch in pieces(whole, "text"):
                tokens, lengths = hashes(text_bytes(batch.column("text")))
                for kind, keys in ((0, tokens), (1, bigrams(tokens, lengths)[1])):
                    held[kind].append(np.unique(keys, return_counts=True))
                    size += len(held[kind][-1][0])
                if size > COMBINED:
                    for kind in held:
                        yield _packed(kind, *_summed(*map(np.concatenate, zip(*held[kind]))), segments)
                        held[kind] = []
                    size = 0
        for kind in held:
            if held[kind]:
                yield _packed(kind, *_summed(*map(np.concatenate, zip(*held[kind]))), segments)

    return run


_MERGED = "seg int, body binary, tokens bigint, types bigint, ends bigint, value double"


def _merge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per segment, from rows sorted by it: its tokens with their counts and its block of the filter, and sums over its tokens."""
    at, held = -1, {0: [], 1: []}

    def merged() -> pa.RecordBatch:
        (tokens, n), (pairs, m) = (_summed(*map(np.concatenate, zip(*held[kind]))) if held[kind] else (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for kind in (0, 1))
        codes = code_of(n), code_of(m)
        shape = Filter(sum(map(entries, codes)))
        bits = shape.block(tokens, codes[0], 0) | shape.block(pairs, codes[1], 1)
        body = struct.pack("<q", len(tokens)) + tokens.tobytes() + n.tobytes() + np.packbits(bits, bitorder="little").tobytes()
        row = at, body, int(n.sum()), len(n), int(n[tokens == END].sum()), float(VALUE[codes[0]].sum())
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64()))], ["seg", "body", "tokens", "types", "ends", "value"])

    for batch in batches:
        for seg, kind, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("seg", "kind", "keys", "counts"))):
            if seg != at:
                if at >= 0:
                    yield merged()
                at, held = seg, {0: [], 1: []}
            held[kind].append((np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.uint32).astype(np.int64)))
    if at >= 0:
        yield merged()


def entries(codes: np.ndarray) -> int:
    """How often n-grams with these codes enter the filter."""
    return int((codes >> MANTISSA).sum()) + int(sum((codes >> i & 1).sum() for i in range(MANTISSA)))


class Filter:
    """A block of the Bloom filter, of (n-gram, octave) and (n-gram, octave, bit)."""

    def __init__(self, entries: int = 0, words: np.ndarray | None = None):
        self.words = words
        self.bits = 64 * len(words) if words is not None else max(64, -(-BITS_PER_ENTRY * entries // 64) * 64)

    def _hashes(self, keys: np.ndarray, tag, kind: int) -> tuple[np.ndarray, np.ndarray]:
        tag = np.asarray(tag, np.uint64) * np.uint64(2) + np.uint64(kind + 1)
        h = mix64(keys + tag * np.full(1, 0x9E3779B97F4A7C15, np.uint64))
        return h, (h >> np.uint64(32)) | np.uint64(1)

    def _place(self, h: np.ndarray, step: np.ndarray, probe: int) -> np.ndarray:
        return (h + np.uint64(probe) * step) % np.uint64(self.bits)

    def _parts(self, octave: np.ndarray, bit: int) -> np.ndarray:
        """The tag of a bit (0 is the highest below the leading one) of counts of an octave."""
        return _OCTAVES + octave * MANTISSA + bit

    def block(self, keys: np.ndarray, codes: np.ndarray, kind: int) -> np.ndarray:
        """The bits that keys set."""
        bits = np.zeros(self.bits, bool)

        def enter(keys: np.ndarray, tag) -> None:
            h, step = self._hashes(keys, tag, kind)
            for probe in range(PROBES):
                bits[self._place(h, step, probe).astype(np.int64)] = True

        octave = codes >> MANTISSA
        for q in range(1, int(octave.max(initial=0)) + 1):
            enter(keys[octave >= q], q)
        for bit in range(MANTISSA):
            there = codes >> (MANTISSA - 1 - bit) & 1 == 1
            enter(keys[there], self._parts(octave[there], bit))
        return bits

    def _holds(self, keys: np.ndarray, tag, kind: int) -> np.ndarray:
        """Indices of the keys whose entry is in the filter."""
        left = np.arange(len(keys))
        h, step = self._hashes(keys, tag, kind)
        for probe in range(PROBES):
            place = self._place(h, step, probe)
            hit = self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1) != 0
            left, h, step = left[hit], h[hit], step[hit]
        return left

    def codes(self, keys: np.ndarray, kind: int) -> np.ndarray:
        """The code of each key, by probing one octave after the other and then the bits."""
        octave = np.zeros(len(keys), np.int64)
        left = np.arange(len(keys))
        for q in range(1, _OCTAVES):
            left = left[self._holds(keys[left], q, kind)]
            if not len(left):
                break
            octave[left] = q
        codes = octave << MANTISSA
        for bit in range(MANTISSA):
            # a count of octave q has q - 1 bits below its highest
            some = np.flatnonzero(octave > bit + 1)
            hit = some[self._holds(keys[some], self._parts(octave[some], bit), kind)]
            codes[hit] |= 1 << (MANTISSA - 1 - bit)
        return codes


def _squeezed(packer: zstandard.ZstdCompressor, *arrays: np.ndarray) -> bytes:
    """Integers as planes of bytes, compressed; the lengths stand in front."""
    planes = b"".join(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    return struct.pack(f"<{len(arrays)}q", *map(len, arrays)) + packer.compress(planes)


def _spread(body: bytes, *types) -> list[np.ndarray]:
    """The arrays of ``_squeezed``."""
    lengths = struct.unpack_from(f"<{len(types)}q", body)
    planes, at, out = zstandard.decompress(body[8 * len(types) :]) if any(lengths) else b"", 0, []
    for n, t in zip(lengths, types):
        wide = np.dtype(t).itemsize
        out.append(np.frombuffer(planes, np.uint8, n * wide, at).reshape(wide, n).T.copy().view(t).ravel() if n else np.zeros(0, t))
        at += n * wide
    return out


def _steps(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as differences."""
    return np.diff(keys, prepend=np.uint64(0))


#: Rows on their way between batches of texts and segments, by kind.
_ROUTED = "seg int, kind int, batch bigint, body binary"
_BLOCK, _BATCH, _ASKED = 0, 1, 2


def _routed(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], ["seg", "kind", "batch", "body"])


def _distinct(tokens: np.ndarray, lengths: np.ndarray):
    """The sorted distinct bigrams of a batch, and where each token's bigram is among them."""
    return np.unique(bigrams(tokens, lengths)[1], return_inverse=True)


def _ask_rows(segments: int):
    """A batch of texts as indices into its distinct tokens, and per segment the n-grams it asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, packer = Tokens(), zstandard.ZstdCompressor(level=1)
        number = TaskContext.get().partitionId() << 20
        for whole in batches:
            for batch in pieces(whole, "text", ASKING):
                tokens, lengths = hashes(text_bytes(batch.column("text")))
                types, at, often = np.unique(tokens, return_inverse=True, return_counts=True)
                # frequent tokens have small numbers, which compress well
                ranked = np.argsort(-often, kind="stable")
                rank = np.empty(len(types), np.uint32)
                rank[ranked] = np.arange(len(types), dtype=np.uint32)
                pairs, _ = _distinct(tokens, lengths)
                sink = pa.BufferOutputStream()
                rows = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), batch.column("used"), pa.array(lengths)], ["doc_id", "held_out", "used", "n_tokens"])
                with pa.ipc.new_stream(sink, rows.schema) as stream:
                    stream.write_batch(rows)
                head = sink.getvalue().to_pybytes()
                edges = [np.searchsorted(_segment(keys, segments), np.arange(segments + 1)) for keys in (types, pairs)]
                full = np.flatnonzero((edges[0][1:] > edges[0][:-1]) | (edges[1][1:] > edges[1][:-1])).tolist()
                out = [(full[number % len(full)], _BATCH, number, struct.pack("<q", len(head)) + head + _squeezed(packer, types[ranked], rank[at]))]
                for s in full:
                    mine = [keys[e[s] : e[s + 1]] for keys, e in zip((types, pairs), edges)]
                    out.append((s, _ASKED, number, _squeezed(packer, *map(_steps, mine))))
                yield _routed(out)
                number += 1

    return run


def _answer_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by segment and kind: n-grams become codes and token counts, batches pass through."""
    at, block, asked, packer = -1, b"", [], zstandard.ZstdCompressor(level=1)

    def answers() -> pa.RecordBatch:
        keys = [[np.cumsum(x) for x in _spread(body, np.uint64, np.uint64)] for _, body in asked]
        n = struct.unpack_from("<q", block)[0] if block else 0
        known, count = (np.frombuffer(block[8 + 8 * n * i : 8 + 8 * n * (i + 1)], t) for i, t in ((0, np.uint64), (1, np.int64))) if n else (None, None)
        held = Filter(words=np.frombuffer(block[8 + 16 * n :], np.uint64)) if block else None
        out = []
        for kind in (0, 1):
            mine = [k[kind] for k in keys]
            flat, edges = np.concatenate(mine), np.cumsum([len(x) for x in mine])[:-1]
            codes = held.codes(flat, kind) if held else np.zeros(len(flat), np.int64)
            out.append(np.split(codes.astype(np.uint16), edges))
            if kind == 0:
                exact = np.zeros(len(flat), np.int64)
                if n:
                    place = np.minimum(np.searchsorted(known, flat), n - 1)
                    exact = np.where(known[place] == flat, count[place], 0)
                out.append(np.split(exact, edges))
        return _routed([(at, _ASKED, number, _squeezed(packer, *x)) for (number, _), *x in zip(asked, *out)])

    for batch in batches:
        for seg, kind, number, body in zip(*(c.to_pylist() for c in batch.columns)):
            if seg != at:
                if asked:
                    yield answers()
                at, block, asked = seg, b"", []
            if kind == _BLOCK:
                block = body
            elif kind == _BATCH:
                yield _routed([(seg, kind, number, body)])
            else:
                asked.append((number, body))
    if asked:
        yield answers()


def _along_tokens(body: bytes, answers: dict[int, bytes]):
    """The rows of a batch; of each token its code and count, and the code of its bigram."""
    n_head = struct.unpack_from("<q", body)[0]
    rows = next(iter(pa.ipc.open_stream(body[8 : 8 + n_head])))
    types, rank = _spread(body[8 + n_head :], np.uint64, np.uint32)
    tokens = types[rank]
    lengths = rows.column("n_tokens").to_numpy()
    found = zip(*(_spread(answers[seg], np.uint16, np.int64, np.uint16) for seg in sorted(answers)))
    of_type, count, of_pair = map(np.concatenate, found)
    place = np.searchsorted(np.sort(types), types)
    return rows, lengths, of_type[place][rank], count[place][rank], of_pair[_distinct(tokens, lengths)[1]]


@dataclass(frozen=True)
class Trained:
    """The model on the driver; the counts and blocks of its segments as a table."""

    segments: int
    blocks: DataFrame | None
    train_tokens: int
    types: int
    texts: int
    value: float
    weights: np.ndarray


def _table(df: DataFrame, name: str) -> DataFrame:
    """``persist_table``, compressed more; the shuffles behind it are given up as soon as it is written."""
    conf = df.sparkSession.conf
    asked = {"spark.sql.parquet.compression.codec": "zstd", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    before = {k: conf.get(k, None) for k in asked}
    try:
        for k, v in asked.items():
            conf.set(k, v)
        return persist_table(df, name)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def _counted(texts: DataFrame) -> Trained:
    """The model of all rows of ``texts(text)``, with equal weights."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    segments = 4 * parts
    packed = texts.select("text").mapInArrow(_count_rows(segments), _PACKED)
    merged = _table(packed.repartition(parts, "seg").sortWithinPartitions("seg").mapInArrow(_merge_rows, _MERGED), "counts")
    total = merged.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "types", "ends")], F.coalesce(F.sum("value"), F.lit(0.0))).first()
    blocks = merged.select("seg", F.lit(_BLOCK).alias("kind"), F.lit(0).cast("bigint").alias("batch"), "body")
    return Trained(segments, blocks, *total, np.where(np.arange(_OCTAVES), 0.3, 0.0))


def _looked_up(docs: DataFrame, model: Trained) -> DataFrame:
    """``docs(doc_id, text, held_out, used)`` with exact figures and the codes of each text's tokens and bigrams, as a table."""
    parts = model.segments // 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def placed(body: bytes, answers: dict[int, bytes]) -> pa.RecordBatch:
            rows, lengths, of_token, count, of_pair = _along_tokens(body, answers)
            start = np.cumsum(lengths) - lengths
            codes = [of_token[i : i + n].tobytes() + of_pair[i : i + n].tobytes() for i, n in zip(start.tolist(), lengths.tolist())]
            known, exact = np.add.reduceat((count > 0).astype(np.int64), start), np.add.reduceat(np.log10(count + 1.0), start)
            return pa.RecordBatch.from_arrays([*rows.columns, pa.array(known), pa.array(exact), pa.array(codes, pa.binary())], ["doc_id", "held_out", "used", "n_tokens", "n_known", "exact", "codes"])

        at, text, answers = -1, b"", {}
        for batch in batches:
            for seg, kind, number, body in zip(*(c.to_pylist() for c in batch.columns)):
                if number != at:
                    if text:
                        yield placed(text, answers)
                    at, text, answers = number, b"", {}
                if kind == _BATCH:
                    text = body
                else:
                    answers[seg] = body
        if text:
            yield placed(text, answers)

    ddl = f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, used boolean, n_tokens bigint, n_known bigint, exact double, codes binary"
    place, found = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(ROUNDS)), []
    for number in range(ROUNDS):
        asked = docs.where(place == number).mapInArrow(_ask_rows(model.segments), _ROUTED)
        answered = model.blocks.unionByName(asked).repartition(parts, "seg").sortWithinPartitions("seg", "kind").mapInArrow(_answer_rows, _ROUTED)
        gathered = answered.repartition(parts, "batch").sortWithinPartitions("batch", "kind")
        found.append(_table(gathered.mapInArrow(run, ddl), "codes"))
    return reduce(DataFrame.unionByName, found)


def train(docs: DataFrame, usable: Column) -> Trained:
    """Count and fit on the rows of ``docs(doc_id, text)`` for which ``usable`` holds."""
    texts = slim(docs.where(usable), "doc_id", "text")
    model = _counted(texts)
    return _tuned(model, _looked_up(texts.select("doc_id", "text", F.lit(False).alias("held_out"), F.lit(True).alias("used")), model))


def train_and_score(docs: DataFrame, usable: Column, held_out: Column) -> DataFrame:
    """``score`` of all rows by a model of those for which ``usable`` holds; the n-grams are looked up once for both."""
    model = _counted(slim(docs.where(usable), "doc_id", "text"))
    rows = _looked_up(docs.select("doc_id", "text", held_out.alias("held_out"), F.coalesce(usable, F.lit(False)).alias("used")), model)
    return _scored(rows, _tuned(model, rows.where("used")))


def _split_codes(codes: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code of the context (-1: start), of the token and of the bigram of the tokens of several texts; where each text starts."""
    lengths = np.array([len(x) // 4 for x in codes], np.int64)
    token = np.frombuffer(b"".join(x[: len(x) // 2] for x in codes), np.uint16).astype(np.int64)
    pair = np.frombuffer(b"".join(x[len(x) // 2 :] for x in codes), np.uint16).astype(np.int64)
    context, start = np.empty_like(token), np.cumsum(lengths) - lengths
    context[1:] = token[:-1]
    context[start] = -1
    return context, token, pair, start


def estimates(model: Trained, context: np.ndarray, token: np.ndarray, pair: np.ndarray, less: int = 0):
    """Per token: octave of the context, bigram estimate, unigram estimate; ``less`` is taken from each count."""
    first = context < 0
    octave = np.where(first, code_of(np.array([model.texts]))[0], context) >> MANTISSA
    before = np.where(first, model.texts, VALUE[np.where(first, 0, context)])
    both = np.minimum(np.maximum(VALUE[pair] - less, 0), before)
    unigram = (np.maximum(VALUE[token] - less, 0) + 1) / (model.value + model.types + 1)
    return octave, both / np.maximum(before - less, 1), unigram


def _gain_rows(model: Trained):
    """The log-likelihood, in millionths and leaving one out, of each weight for each octave of contexts."""
    names = ["octave", *(f"g{i}" for i in range(len(GRID)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((_OCTAVES, len(GRID)))
        for batch in batches:
            if batch.num_rows:
                octave, bigram, unigram = estimates(model, *_split_codes(batch.column("codes").to_pylist())[:3], less=1)
                bigram = np.minimum(bigram, 1.0)
                for i, w in enumerate(GRID):
                    total[:, i] += np.bincount(octave, np.log10(w * bigram + (1 - w) * unigram), _OCTAVES)
        at = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(np.rint(1e6 * total[at, i]).astype(np.int64)) for i in range(len(GRID)))], names)

    return run, "octave int, " + ", ".join(f"{c} bigint" for c in names[1:])


def _tuned(model: Trained, rows: DataFrame) -> Trained:
    """The weight of the bigram estimate for each octave of contexts, by leaving one out on all training texts.

    An unseen context has no bigrams, and so no weight; an octave that no text
    reaches has the weight of the one nearest to it.
    """
    run, ddl = _gain_rows(replace(model, blocks=None))
    sums = rows.select("codes").mapInArrow(run, ddl).groupBy("octave").agg(*[F.sum(f"g{i}") for i in range(len(GRID))]).collect()
    if not sums:
        return model
    reached = np.array([r[0] for r in sums])
    best = GRID[np.array([r[1:] for r in sums], float).argmax(1)]
    weights = best[np.abs(np.arange(_OCTAVES)[:, None] - reached).argmin(1)]
    weights[0] = 0.0
    return replace(model, weights=weights)


def score(docs: DataFrame, model: Trained, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of ``docs(doc_id, text)``.

    base_score is the exact add-one unigram score, score the model's log10
    probability of the whole text.
    """
    return _scored(_looked_up(docs.select("doc_id", "text", held_out.alias("held_out"), F.lit(False).alias("used")), model), model)


def _scored(rows: DataFrame, model: Trained) -> DataFrame:
    model = replace(model, blocks=None)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "exact"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                context, token, pair, start = _split_codes(batch.column("codes").to_pylist())
                octave, bigram, unigram = estimates(model, context, token, pair)
                w = model.weights[octave]
                scores = np.add.reduceat(np.log10(w * bigram + (1 - w) * unigram), start)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(scores)], [*names, "score"])

    each = rows.select(*names, "codes").mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, n_tokens bigint, n_known bigint, exact double, score double")
    space = float(np.log10(model.train_tokens + model.types + 1))
    return each.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(model.train_tokens).cast("bigint").alias("train_tokens"),
        (F.col("exact") - F.col("n_tokens") * space).alias("base_score"),
        "score",
    )
