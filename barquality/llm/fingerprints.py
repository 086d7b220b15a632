"""Document fingerprints: a canonical exact digest.

The canonical form of a text is its NFKC normalisation, case-folded, with every
run of white space as one space and none at the ends.  The fingerprint is the
128-bit xxhash of its UTF-8 bytes; inside a bucket of equal hashes the bytes
themselves are compared with those of the bucket's first document, and a text
that differs gets the SHA-256 of its bytes appended.  Likeness of two exact
fingerprints is 1 when they are equal and 0 otherwise.

A null text is empty; empty texts are equal to each other and to texts of white
space alone.  Very long texts are handled whole, one at a time.  Null ids come
first in the order of ids, equal ids are ordered by a digest of the text, so
repeated rows have a defined successor.  One row is its own successor.  An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import persist_table, pieces, slim, texts_of
from .ngram_join import bit_filter

_SPACE = re.compile(r"\s+")


def canonical(text: str) -> str:
    if text.isascii():
        return " ".join(text.lower().split())
    # folding can leave a form that normalisation changes again
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split())


def fingerprint(text: str) -> str:
    return _digest(canonical(text))


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n/2) code points replaced by the first as many of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_DDL = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_OPEN_DDL = f"{_DDL}, part int, role int, text string"
_DONE, _LAST, _FIRST = 0, 1, 2


def _digest(form: str) -> str:
    return xxhash.xxh3_128_hexdigest(form.encode("utf-8", "surrogatepass"))


def _row(doc_id, text: str, form: str, following: str, next_form: str) -> tuple:
    """The figures of a row; likeness is of the canonical texts themselves."""
    new = edited(text, following)
    new_form = canonical(new)
    sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), sha, _digest(form), _digest(new_form), float(new_form == form), float(next_form == form)


def _chained(doc_type: pa.DataType):
    """Rows in order; the first and the last of a task go out as they are, to be joined with other tasks'."""
    types = [doc_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.string()]
    names = [*_COLUMNS, "part", "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held = None
        for whole in batches:
            for batch in pieces(whole, "text"):
                out = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text"))):
                    form = canonical(text)
                    if held is None:
                        out.append((doc_id, len(text), None, None, None, None, None, part, _FIRST, text))
                    else:
                        out.append((*_row(*held, text, form), part, _DONE, None))
                    held = doc_id, text, form
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)
        if held:
            row = (held[0], len(held[1]), None, None, None, None, None, part, _LAST, held[1])
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names)

    return run


def _closed(doc_type: pa.DataType):
    types = [doc_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            out = [_row(r["doc_id"], r["text"], canonical(r["text"]), r["next_text"], canonical(r["next_text"])) for r in rows]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], _COLUMNS)

    return run


def successors(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Each row against the next in ascending doc_id (after the last: the first).
    The rows are sorted once, in parallel; only the first and the last row of
    each task are matched in a second step.
    """
    docs = slim(docs, "doc_id", "text").withColumn("_tie", F.md5(F.coalesce("text", F.lit(""))))
    kind = dict(docs.dtypes)["doc_id"]
    doc_type = to_arrow_type(docs.schema["doc_id"].dataType)
    key = [F.col("doc_id").asc_nulls_first(), F.col("_tie").asc()]
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    ordered = docs.repartitionByRange(parts, *key).sortWithinPartitions(*key).drop("_tie")
    rows = persist_table(ordered.mapInArrow(_chained(doc_type), f"doc_id {kind}, {_OPEN_DDL}"), "chained")
    # one first and one last row per task: as many rows as tasks, not as documents
    ends = rows.where(F.col("role") != _DONE)
    heads = ends.where(F.col("role") == _FIRST).select("part", F.col("text").alias("next_text"))
    order = Window.orderBy("part")
    follows = heads.select("part", F.lead("part").over(order).alias("after"), F.min("part").over(Window.partitionBy()).alias("least"))
    follows = follows.select("part", F.coalesce("after", "least").alias("after"))
    tails = ends.where(F.col("role") == _LAST).select("doc_id", "text", "part")
    tails = tails.join(follows, "part").join(heads.withColumnRenamed("part", "after"), "after")
    closed = tails.select("doc_id", "text", "next_text").mapInArrow(_closed(doc_type), f"doc_id {kind}, {_DDL}")
    return rows.where(F.col("role") == _DONE).select(*_COLUMNS).unionByName(closed)


def _canonical_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pieces(whole, "text"):
            forms = [canonical(t) for t in texts_of(batch.column("text"))]
            marks = [xxhash.xxh3_128_hexdigest(f.encode("utf-8", "surrogatepass")) for f in forms]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(marks, pa.string()), pa.array(forms, pa.string())], ["doc_id", "fingerprint", "form"])


def compared(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """``fingerprint, sha`` of canonical texts that differ from the first text of their hash bucket.

    ``marks(doc_id, fingerprint)`` are known; only texts of buckets with more
    than one document are read into the comparison.
    """
    docs = slim(docs, "doc_id", "text")
    kind = dict(docs.dtypes)["doc_id"]
    shared = persist_table(marks.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1"), "shared-marks")
    forms = docs.mapInArrow(_canonical_rows, f"doc_id {kind}, fingerprint string, form string")
    forms = bit_filter(forms, shared.select("fingerprint"), "fingerprint").join(shared, "fingerprint")
    first = forms.where(F.col("doc_id").eqNullSafe(F.col("first_id"))).groupBy("fingerprint").agg(F.min("form").alias("first_form"))
    return forms.join(first, "fingerprint").where("form != first_form").select("fingerprint", "doc_id", F.sha2("form", 256).alias("sha"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``successors`` with fingerprints that are exact: equal only for equal canonical bytes.

    Adds group_id (smallest doc_id with the same canonical text) and group_size.
    """
    rows = persist_table(successors(docs), "fingerprints")
    unlike = persist_table(compared(docs, rows.select("doc_id", "fingerprint")).distinct(), "unlike")
    named = rows.join(unlike.withColumnRenamed("fingerprint", "_mark").withColumnRenamed("doc_id", "_id"), (F.col("fingerprint") == F.col("_mark")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    named = named.withColumn("fingerprint", F.concat_ws("-", "fingerprint", "sha")).select(*_COLUMNS)
    groups = named.groupBy("fingerprint").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("group_size"))
    return named.join(groups, "fingerprint").select(*_COLUMNS, "group_id", "group_size")
