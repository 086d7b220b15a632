"""SentencePiece encoding and decoding: batched numpy Viterbi.

The vocabulary is a published model file; nothing is trained.  Spaces become
the marker U+2581, with one in front of the text, and the text is cut where no
piece can cross: before a run of markers, and around characters that no piece
holds (those become byte pieces).  The distinct words of a batch are encoded
once: words of equal length advance together, the hashes of their substrings
probe the sorted hashes of all pieces, and a vectorised maximum over the pieces
that end at a position stores its back pointer.

Path scores follow the model.  A unigram model adds the scores of its pieces.
A merge (BPE) model has one valid path: that on which every two neighbours are
what merging their joint text gives, so a path is worth 0 or minus infinity,
and the maximum is the valid predecessor.  Both give the ids of the library
that defines the format.

A null or empty text has no pieces.  Very long texts and words are
encoded whole, in steps proportional to their length.  Repeated
rows give repeated results; an empty table an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mix64, pieces, release, slim, texts_of

MARK = "▁"
_NORMAL, _UNKNOWN, _BYTE = 1, 2, 6
_UNIGRAM, _BPE = 1, 2
_BASE = np.uint64(0x100000001B3)
_INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))
#: Bytes of distinct words that a worker keeps with their ids, and what an entry takes beside its characters.
CACHE_BYTES, ENTRY_BYTES = 32 << 20, 200
#: Characters of the words that advance together.
CELLS = 1 << 16
#: Bytes of the texts that are encoded together.
TOGETHER = 1 << 19
#: Slots of a worker's table of checked pairs, and of the directory of the sorted keys.
PAIR_BITS, DIRECTORY_BITS = 20, 18
_NEVER = -(10.0**18)


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of every field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        elif tag & 7 == 2:
            n = varint()
            at += n
            yield tag >> 3, data[at - n : at]
        else:
            n = 4 if tag & 7 == 5 else 8
            at += n
            yield tag >> 3, struct.unpack("<f" if n == 4 else "<d", data[at - n : at])[0]


def _prefix_hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every prefix (character i weighs base to the power i) and the inverse powers.

    The hash of text[i:j] by itself is (prefix[j] - prefix[i]) * inverse[i].
    """
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    power, inverse = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(codes), x)])) for x in (_BASE, _INVERSE))
    return np.concatenate([[np.uint64(0)], np.cumsum(codes * power[:-1])]), inverse


class Model:
    """Pieces, scores and kinds of a ``.model`` file, and the search over them."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        kinds: list[int] = []
        self.kind, self.dummy_prefix = _UNIGRAM, True
        for number, value in _fields(data):
            if number == 1:
                piece = {1: b"", 2: 0.0, 3: _NORMAL} | dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(piece[2])
                kinds.append(piece[3])
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, _UNIGRAM)
            elif number == 3:
                spec = dict(_fields(value))
                self.dummy_prefix = bool(spec.get(3, 1))
                if spec.get(2) or spec.get(4, 1) or not spec.get(5, 1):
                    raise ValueError("only models without a character map, extra white space removal or raw spaces are supported")
        if self.kind not in (_UNIGRAM, _BPE):
            raise ValueError("only unigram and BPE models are supported")
        self.normal = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == _NORMAL}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == _BYTE}
        self.unknown = kinds.index(_UNKNOWN)
        if any(MARK in p.lstrip(MARK) for p in self.normal):
            raise ValueError("pieces across words are not supported")
        chars = {c for p in self.normal for c in p}
        # a known character that is no piece of its own could leave a word without a path
        self.alphabet = frozenset(c for c in chars if c in self.normal)
        self.normal = {p: i for p, i in self.normal.items() if set(p) <= self.alphabet}
        self.longest = max(map(len, self.normal))
        self.text = [bytes([int(p[3:5], 16)]) if k == _BYTE else p.encode() if k == _NORMAL else b"" for p, k in zip(self.pieces, kinds)]
        inside = re.escape("".join(sorted(self.alphabet - {MARK})))
        self.cut = re.compile(f"{MARK}*[{inside}]+|{MARK}+|[^{inside}{MARK}]")
        # merges come in the order of the scores; single characters come before all of them
        place = {s: i + 1 for i, s in enumerate(sorted({self.scores[i] for p, i in self.normal.items() if len(p) > 1}, reverse=True))}
        self.rank = {i: place[self.scores[i]] if len(p) > 1 else 0 for p, i in self.normal.items()}
        ids = np.array(list(self.normal.values()))
        sizes = np.array([len(p) for p in self.normal])
        ends = np.cumsum(sizes)
        prefix, inverse = _prefix_hashes("".join(self.normal))
        plain = (prefix[ends] - prefix[ends - sizes]) * inverse[ends - sizes]
        self.piece_hash, self.piece_power = (np.zeros(len(self.pieces), np.uint64) for _ in range(2))
        self.piece_hash[ids], self.piece_power[ids] = plain, np.cumprod(np.full(self.longest, _BASE))[sizes - 1]
        keys = mix64(plain)
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], ids[order]
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces share a hash")
        # where the keys of each prefix of their bits begin, and the most that share one
        slots = (self.keys >> np.uint64(64 - DIRECTORY_BITS)).astype(np.int64)
        self.directory = np.searchsorted(slots, np.arange((1 << DIRECTORY_BITS) + 1)).astype(np.int32)
        self.crowd = int(np.diff(self.directory).max())
        self.keys = np.concatenate([self.keys, np.zeros(self.crowd, np.uint64)])
        self.used = np.diff(self.directory) > 0
        self.slot_pair, self.slot_ok = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)
        self.forget()
        self.piece_rank = np.zeros(len(self.pieces), np.int64)
        self.piece_rank[list(self.rank)] = list(self.rank.values())
        self.part_left, self.part_right = (np.full(len(self.pieces), -2, np.int64) for _ in range(2))
        self.piece_scores = np.array(self.scores)
        self.piece_chars = np.array([len(p) for p in self.pieces])
        self.piece_bytes = np.array([len(t) for t in self.text])
        self.bytes_start = np.cumsum(self.piece_bytes) - self.piece_bytes
        self.bytes_flat = np.frombuffer(b"".join(self.text), np.uint8)

    # -- merge order -----------------------------------------------------

    def split(self, piece: int) -> tuple[int, int] | None:
        """The two pieces that merge into this one, last; None where merging its text gives others."""
        parts = list(self.pieces[piece])
        while len(parts) > 2:
            best = min(((self.rank[m], i) for i in range(len(parts) - 1) if (m := self.normal.get(parts[i] + parts[i + 1])) is not None and m != piece), default=None)
            if best is None:
                return None
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return self.normal[parts[0]], self.normal[parts[1]]

    def _parts(self, pieces_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last merge of each piece; -1 where merging its text does not give it."""
        for p in np.unique(pieces_[self.part_left[pieces_] == -2]).tolist():
            self.part_left[p], self.part_right[p] = self.split(p) or (-1, -1)
        return self.part_left[pieces_], self.part_right[pieces_]

    def follows(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the joint text of two pieces gives these two; -1 on the left is the start of a word.

        The last merges of both are undone, latest first; a merge across the border
        that comes before the undone one would have been made.
        """
        rank, ok = self.piece_rank, np.ones(len(left), bool)
        merged = np.flatnonzero(rank[right] > 0)
        ok[merged] = self._parts(right[merged])[0] >= 0
        at = np.flatnonzero(ok & (left >= 0))
        left, right, limit = left[at], right[at], np.full(len(at), np.iinfo(np.int64).max)
        while len(at):
            hit, joint = self._lookup(mix64(self.piece_hash[left] + self.piece_power[left] * self.piece_hash[right]))
            ok[at[hit[rank[joint] < limit[hit]]]] = False
            a, b = rank[left], rank[right]
            go = np.flatnonzero(ok[at] & ((a > 0) | (b > 0)))
            at, left, right, a, b = at[go], left[go], right[go], a[go], b[go]
            later = a > b
            limit = np.where(later, a, b + 1)
            left[later] = self._parts(left[later])[1]
            right[~later] = self._parts(right[~later])[0]
        return ok

    def valid(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``follows``, with answers kept in a table of fixed size, each pair in one slot."""
        pairs = (left + 1) << 32 | right
        slots = (mix64(pairs.view(np.uint64)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        miss = np.flatnonzero(self.slot_pair[slots] != pairs)
        ok = self.slot_ok[slots]
        if len(miss):
            new, back = np.unique(pairs[miss], return_inverse=True)
            found = self.follows((new >> 32) - 1, new & 0xFFFFFFFF)
            ok[miss] = found[back]
            at = (mix64(new.view(np.uint64)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
            at, one = np.unique(at, return_index=True)
            self.slot_pair[at], self.slot_ok[at] = new[one], found[one]
        return ok

    # -- search ----------------------------------------------------------

    def encode_words(self, words: list[str]) -> list[tuple[str, bytes]]:
        """Words over the alphabet with their ids as little-endian 32-bit integers, shorter words first."""
        words = sorted(words, key=len)
        ends = np.cumsum([len(w) for w in words])
        out, at = [], 0
        while at < len(words):
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + CELLS, "right")))
            ids, counts = self._together(words[at:end])
            packed, edges = ids.tobytes(), [0, *(4 * np.cumsum(counts)).tolist()]
            out += [packed[a:b] for a, b in zip(edges, edges[1:])]
            at = end
        return list(zip(words, out))

    def _lookup(self, mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, id) of the hashes that are keys."""
        slot = (mixed >> np.uint64(64 - DIRECTORY_BITS)).view(np.int64)
        hit = np.flatnonzero(self.used[slot])
        probe, at = mixed[hit], self.directory[slot[hit]].astype(np.int64)
        sure = self.keys[at] == probe
        for _ in range(1, self.crowd):
            at = np.where(sure, at, at + 1)
            sure = self.keys[at] == probe
        return hit[sure], self.key_ids[at[sure]]

    def _matches(self, words: list[str], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(end in the word, position of the start, word, id) of every piece in every word, by end; of equal ends the longest first.

        The words lie end to end.  One round per piece length: the hashes of all
        substrings of that length come from hashes of prefixes and probe the keys at once.
        """
        prefix, inverse = _prefix_hashes("".join(words))
        ends = np.cumsum(lengths)
        word = np.repeat(np.arange(len(words)), lengths)
        at, found = np.arange(len(word)), []
        for length in range(1, min(int(lengths[-1]), self.longest) + 1):
            at = at[at + length <= ends[word[at]]]
            hit, ids = self._lookup(mix64((prefix[at + length] - prefix[at]) * inverse[at]))
            found.append((at[hit], ids, np.full(len(hit), length)))
        start, ids, length = map(np.concatenate, zip(*found[::-1]))
        word = word[start]
        end = start + length - (ends - lengths)[word]
        order = np.argsort(end.astype(np.uint16) if lengths[-1] < 1 << 16 else end, kind="stable")
        return end[order], start[order], word[order], ids[order]

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words sorted by length, laid end to end, and how many each has.

        At each step all words that are long enough move one character on.
        """
        lengths = np.array([len(w) for w in words])
        end, start, word, ids = self._matches(words, lengths)
        edges = np.searchsorted(end, np.arange(lengths[-1] + 2))
        # one state before each character and one at the end of each word
        came = start + word
        place = came + self.piece_chars[ids]
        first = np.cumsum(lengths) - lengths + np.arange(len(words))
        best = np.full(int(lengths.sum()) + len(words), _NEVER)
        best[first] = 0.0
        last = np.full(len(best), -1, np.int64)
        for at in range(1, len(edges) - 1):
            part = np.arange(edges[at], edges[at + 1])
            part = part[best[came[part]] > _NEVER]
            if self.kind == _BPE:
                part = part[self.valid(last[came[part]], ids[part])]
                score = best[came[part]]
            else:
                score = best[came[part]] + self.piece_scores[ids[part]]
                # the last of a state's candidates stays: the best, of equal ones the longest
                order = np.lexsort((-np.arange(len(part)), score))
                part, score = part[order], score[order]
            best[place[part]], last[place[part]] = score, ids[part]
        rows, at, steps = np.arange(len(words)), first + lengths, []
        while len(rows):
            piece = last[at]
            steps.append((rows, piece))
            at = at - self.piece_chars[piece]
            on = at > first[rows]
            rows, at = rows[on], at[on]
        rows, ids = map(np.concatenate, zip(*steps[::-1]))
        return ids[np.argsort(rows, kind="stable")].astype("<i4"), np.bincount(rows, minlength=len(words))

    def _other(self, char: str) -> bytes:
        """A character that no piece holds: its bytes, or the unknown piece."""
        data = char.encode("utf-8", "surrogatepass")
        return np.array([self.byte_ids[b] for b in data] if self.byte_ids else [self.unknown], "<i4").tobytes()

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """The ids of every text, as little-endian 32-bit integers."""
        cut = [self.cut.findall((MARK if self.dummy_prefix else "") + t.replace(" ", MARK)) if t else [] for t in texts]
        words = set(chain.from_iterable(cut))
        new = words.difference(self.cache)
        if new:
            size = sum(map(len, new)) * 4 + len(new) * ENTRY_BYTES
            if self.cached + size > CACHE_BYTES:
                # what these texts hold stays, as frequent words come again
                old, self.cache = self.cache, {}
                self.cache = {w: old[w] for w in words - new}
                self.cached = sum(map(len, self.cache)) * 4 + len(self.cache) * ENTRY_BYTES
            self.cached += size
            known = [w for w in new if w[-1] in self.alphabet]
            self.cache.update(self.encode_words(known))
            self.cache.update((w, self._other(w)) for w in new if w[-1] not in self.alphabet)
        get = self.cache.__getitem__
        return [b"".join(map(get, words)) for words in cut]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of every text."""
        return [np.frombuffer(x, "<i4").tolist() for x in self.encode_packed(texts)]

    def forget(self) -> None:
        """Drop the words kept by this worker."""
        self.cache, self.cached = {}, 0

    def decode_packed(self, texts: list[bytes]) -> list[str]:
        """The texts of packed ids; bytes that are no UTF-8 become replacement characters."""
        flat = np.frombuffer(b"".join(texts), "<i4")
        sizes = self.piece_bytes[flat]
        ends = np.cumsum(sizes)
        data = self.bytes_flat[np.repeat(self.bytes_start[flat] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        ends, out, at, n = np.concatenate([[0], ends]), [], 0, 0
        for text in texts:
            n += len(text) // 4
            found = data[at : int(ends[n])].decode("utf-8", "replace").replace(MARK, " ")
            out.append(found[1:] if self.dummy_prefix and found[:1] == " " else found)
            at = int(ends[n])
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids."""
        return self.decode_packed([np.array(ids, "<i4").tobytes()])[0]


_models: dict[int, Model] = {}


def _model(data: bytes) -> Model:
    """The model of this worker, built once."""
    key = hash(data)
    if key not in _models:
        _models.clear()
        _models[key] = Model(data)
    return _models[key]


def encode(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, ids (array<int>), decoded: the pieces of every text and what they decode to.

    ``model_file`` is read on the driver (a vocabulary of fixed size) and
    travels to the workers once, as a broadcast.
    """
    docs = slim(docs, "doc_id", "text")

    def rows(model: Model, batch: pa.RecordBatch):
        packed = model.encode_packed(texts_of(batch.column("text")))
        return [batch.column("doc_id"), _lists(packed), pa.array(model.decode_packed(packed), pa.string())]

    return _mapped(docs, model_file, rows, ["doc_id", "ids", "decoded"], f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>, decoded string")


def digests(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_chars, n_pieces, n_byte_pieces, ids_sha256, round_trip, ids of every row.

    ids (array<int>) are the pieces; ids_sha256 is over them as little-endian
    32-bit integers; round_trip says whether decoding gives the text again
    (markers in the text read as spaces).
    """
    docs = slim(docs, "doc_id", "text")

    def rows(model: Model, batch: pa.RecordBatch):
        texts = texts_of(batch.column("text"))
        packed = model.encode_packed(texts)
        low, high = min(model.byte_ids.values(), default=0), max(model.byte_ids.values(), default=-1)
        ids = [np.frombuffer(x, "<i4") for x in packed]
        same = [a == b.replace(MARK, " ") for a, b in zip(model.decode_packed(packed), texts)]
        return [
            batch.column("doc_id"),
            pa.array(map(len, texts), pa.int64()),
            pa.array(map(len, ids), pa.int64()),
            pa.array([int(((x >= low) & (x <= high)).sum()) for x in ids], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in packed], pa.string()),
            pa.array(same, pa.bool_()),
            _lists(packed),
        ]

    names = ["doc_id", "n_chars", "n_pieces", "n_byte_pieces", "ids_sha256", "round_trip", "ids"]
    return _mapped(docs, model_file, rows, names, f"doc_id {dict(docs.dtypes)['doc_id']}, n_chars bigint, n_pieces bigint, n_byte_pieces bigint, ids_sha256 string, round_trip boolean, ids array<int>")


def _lists(packed: list[bytes]) -> pa.Array:
    """A list<int32> array from packed ids."""
    offsets = np.zeros(len(packed) + 1, np.int32)
    np.cumsum([len(x) // 4 for x in packed], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4")))


def _mapped(docs: DataFrame, model_file: str, rows, names: list[str], ddl: str) -> DataFrame:
    with open(model_file, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(data.value)
        for whole in batches:
            for batch in pieces(whole, "text", TOGETHER):
                yield pa.RecordBatch.from_arrays(rows(model, batch), names)
        # a worker outlives its task; what it has cached would stay in its memory
        model.forget()
        release()

    return docs.mapInArrow(run, ddl)
