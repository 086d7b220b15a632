"""License scans: phrases in place, and an exact set join of text blocks with templates.

The words of a text are cut into overlapping blocks.  A template of up to
``2^s`` words meets blocks of ``2^(s+1)`` words that begin every ``2^s``, so
every passage as long as the template lies whole inside some block.  A block
meets a template when it holds at least ``percent`` of the template's distinct
words.  All such pairs are found, by a set-similarity join:

* the words of the templates are ordered by their frequency in all documents,
  rarest first (one pass that sends a count per word and task);
* prefix: a block that meets a template of n words, of which a are needed,
  holds one of its n - a + 1 rarest words, so only blocks around these words
  are looked at, and only for the templates they are indexed under;
* length: the block has at least a words of the templates' vocabulary;
* position: words before and after the shared one in both sorted sets can
  still make up a;
* what passes is verified on the sets.

Templates are a parameter with a stated bound (``MOST_WORDS``), so their index
is sent to the workers; documents are never shuffled, and a lost executor costs
the rows of its tasks.  Work per text is linear in its words and the templates
that share a prefix word.

Where blocks of two templates overlap and the words of one are a proper subset
of the other's, the label of the smaller is not given there (the text of the
lesser public license holds every word of the general one's name).

A null or empty text has no words, no labels and score 0; very long texts are
taken whole, one at a time; repeated rows give repeated results; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import pieces, slim, text_bytes

#: Bound on the words of all templates, whose index every worker holds.
MOST_WORDS = 1_000_000
#: Lower-cases A-Z and turns every ASCII character that is no letter or digit into a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


@dataclass(frozen=True)
class Template:
    label: str
    text: str


#: The phrases of the base labels.
PHRASES = (
    Template("mit", "under the mit license"),
    Template("apache-2", "apache license version 2"),
    Template("cc-by-nc", "cc by nc"),
)

#: Names and notices as the published licenses state them.
TEMPLATES = (
    Template("mit", "The MIT License"),
    Template("mit", "SPDX-License-Identifier: MIT"),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    Template("apache-2", "Apache License, Version 2.0"),
    Template("apache-2", "SPDX-License-Identifier: Apache-2.0"),
    Template("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    Template("gpl", "GNU General Public License"),
    Template("gpl-2", "GNU General Public License, version 2"),
    Template("gpl-3", "GNU General Public License, version 3"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("lgpl", "GNU Lesser General Public License"),
    Template("lgpl", "GNU Lesser General Public License, version 2.1"),
    Template("lgpl", "GNU Lesser General Public License, version 3"),
    Template("agpl", "GNU Affero General Public License"),
    Template("agpl", "GNU Affero General Public License, version 3"),
    Template("mpl-2", "Mozilla Public License"),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    Template("bsd", "BSD 3-Clause License"),
    Template("bsd", "BSD 2-Clause License"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    Template("epl-2", "Eclipse Public License"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
    Template("cc0", "Creative Commons CC0 1.0 Universal"),
    Template("cc-by", "Creative Commons Attribution"),
    Template("cc-by-sa", "Creative Commons Attribution-ShareAlike"),
    Template("cc-by-nc", "Creative Commons Attribution-NonCommercial"),
    Template("cc-by-nc-sa", "Creative Commons Attribution-NonCommercial-ShareAlike"),
    Template("cc-by-nd", "Creative Commons Attribution-NoDerivatives"),
)

PERCENT = 90


def words_of(data: bytes) -> list[bytes]:
    return data.translate(_FOLD).split()


def needed(n: int, percent: int) -> int:
    """How many of ``n`` distinct words make up ``percent`` of them."""
    return -(-percent * n // 100)


def step_of(n_words: int) -> int:
    """How far apart the blocks for a template of so many words begin; they are twice as long."""
    return 1 << max(n_words - 1, 1).bit_length()


class Scanner:
    """Templates indexed by their rarest words."""

    def __init__(self, templates: Sequence[Template] = TEMPLATES, phrases: Sequence[Template] = PHRASES, percent: int = PERCENT, counts: dict[bytes, int] | None = None):
        parsed = [words_of(t.text.encode()) for t in templates]
        self.sought = [words_of(p.text.encode()) for p in phrases]
        if not all(parsed) or not all(self.sought):
            raise ValueError("a template or phrase has no words")
        if sum(map(len, parsed)) > MOST_WORDS:
            raise ValueError(f"templates have more than {MOST_WORDS} words")
        counts = counts or {}
        known = sorted({w for ws in (*parsed, *self.sought) for w in ws}, key=lambda w: (counts.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(known)}
        self.words = known
        self.templates, self.phrases = tuple(templates), tuple(phrases)
        self.sets = [sorted({self.rank[w] for w in ws}) for ws in parsed]
        self.members = [frozenset(s) for s in self.sets]
        self.needs = [needed(len(s), percent) for s in self.sets]
        self.steps = [step_of(len(ws)) for ws in parsed]
        self.under: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, (ranks, need) in enumerate(zip(self.sets, self.needs)):
            for i, r in enumerate(ranks[: len(ranks) - need + 1]):
                self.under[r].append((t, i))
        self.leads = np.zeros(len(known) + 1, bool)
        self.leads[list(self.under)] = True
        self.within = {
            t: {u for u in range(len(parsed)) if self.members[t] < self.members[u] and templates[t].label != templates[u].label} for t in range(len(parsed))
        }

    def ranks_of(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word; -1 where no template or phrase has it."""
        return np.fromiter(map(self.rank.get, words, repeat(-1)), np.int32, len(words))

    def places(self, ranks: np.ndarray) -> list[np.ndarray]:
        """Per phrase the places where its words stand one after another."""
        found = []
        for phrase in self.sought:
            own = [self.rank[w] for w in phrase]
            offset = own.index(min(own))
            at = np.flatnonzero(ranks == own[offset]) - offset
            at = at[(at >= 0) & (at + len(own) <= len(ranks))]
            for j, r in enumerate(own):
                at = at[ranks[at + j] == r]
            found.append(at)
        return found

    def blocks(self, ranks: np.ndarray) -> list[tuple[int, int, int]]:
        """Every template and block that meet: template, first word of the block, shared words."""
        found, tried, sets = [], set(), {}
        for p in np.flatnonzero(self.leads[ranks]).tolist():
            r = int(ranks[p])
            for t, i in self.under[r]:
                step, mine, need = self.steps[t], self.sets[t], self.needs[t]
                for b in (p // step - 1, p // step):
                    if b < 0 or (t, b) in tried:
                        continue
                    block = sets.get((step, b))
                    if block is None:
                        held = np.unique(ranks[b * step : (b + 2) * step])
                        block = sets[step, b] = held[held >= 0].tolist()
                    if len(block) < need:
                        continue
                    j = bisect_left(block, r)
                    if min(i, j) + 1 + min(len(mine) - i, len(block) - j) - 1 < need:
                        continue
                    tried.add((t, b))
                    shared = len(self.members[t].intersection(block))
                    if shared >= need:
                        found.append((t, b * step, shared))
        return found

    def standing(self, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Without blocks of a template whose words are part of those of one that meets the same place."""
        at: dict[int, list[int]] = defaultdict(list)
        for t, first, _ in found:
            at[t].append(first)
        for firsts in at.values():
            firsts.sort()

        def covered(t: int, first: int) -> bool:
            end = first + 2 * self.steps[t]
            for u in self.within[t]:
                firsts = at.get(u, ())
                k = bisect_left(firsts, end) - 1
                if k >= 0 and firsts[k] + 2 * self.steps[u] > first:
                    return True
            return False

        return [x for x in found if not covered(x[0], x[1])]


_SCAN = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, n_blocks bigint"
_FOUND = "label string, template int, first_word bigint, end_word bigint, shared int, containment double"


def _counted(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = sent.value
        counts = np.zeros(len(scanner.words) + 1, np.int64)
        for whole in batches:
            for batch in pieces(whole, "text"):
                for data in text_bytes(batch.column("text")):
                    counts += np.bincount(scanner.ranks_of(words_of(data)) + 1, minlength=len(counts))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(scanner.words)), pa.int32()), pa.array(counts[1:])], ["word", "n"])

    return run


def ordered_by_frequency(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, phrases: Sequence[Template] = PHRASES, percent: int = PERCENT) -> Scanner:
    """A scanner whose words are ordered by how often they stand in all documents."""
    plain = Scanner(templates, phrases, percent)
    sent = docs.sparkSession.sparkContext.broadcast(plain)
    counts = slim(docs, "text").mapInArrow(_counted(sent), "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    # as many rows as the templates have words
    return Scanner(templates, phrases, percent, {plain.words[r["word"]]: r["n"] for r in counts.collect()})


def _scanned(sent):
    def one(scanner: Scanner, data: bytes) -> tuple:
        words = words_of(data)
        ranks = scanner.ranks_of(words)
        places = scanner.places(ranks)
        base = {p.label for p, at in zip(scanner.phrases, places) if len(at)}
        every = np.concatenate(places) if places else np.zeros(0, np.int64)
        found = scanner.standing(scanner.blocks(ranks))
        labels = base | {scanner.templates[t].label for t, _, _ in found}
        score = max((shared / len(scanner.sets[t]) for t, _, shared in found), default=0.0)
        ends = (int(every.min()), int(every.max())) if len(every) else (None, None)
        return len(words), len(every), *ends, ",".join(sorted(base)), ",".join(sorted(labels)), score, len(found)

    types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.int64()]
    names = [x.split()[0] for x in _SCAN.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = sent.value
        for whole in batches:
            for batch in pieces(whole, "text"):
                rows = [one(scanner, data) for data in text_bytes(batch.column("text"))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, t) for x, t in zip(zip(*rows), types))], ["doc_id", *names])

    return run


def scan(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks of every document.

    ``score`` is the greatest share of a template's words in a block of the
    document that meets it, 0 without one; ``n_blocks`` counts these.
    """
    docs = slim(docs, "doc_id", "text")
    sent = docs.sparkSession.sparkContext.broadcast(scanner or ordered_by_frequency(docs))
    return docs.mapInArrow(_scanned(sent), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_SCAN}")


def matches(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """One row per block and template that meet: where the block is, and what they share."""
    docs = slim(docs, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType
    sent = docs.sparkSession.sparkContext.broadcast(scanner or ordered_by_frequency(docs))
    types = [to_arrow_type(kind), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.float64()]
    names = ["doc_id", *(x.split()[0] for x in _FOUND.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for whole in batches:
            for batch in pieces(whole, "text"):
                for doc_id, data in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text"))):
                    words = words_of(data)
                    rows = [
                        (doc_id, held.templates[t].label, t, first, min(first + 2 * held.steps[t], len(words)), shared, shared / len(held.sets[t]))
                        for t, first, shared in held.blocks(held.ranks_of(words))
                    ]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

    return docs.mapInArrow(run, f"doc_id {kind.simpleString()}, {_FOUND}")
