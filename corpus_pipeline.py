"""A training corpus from raw documents, in five stages.

Each stage works on all rows that the one before kept; its result is written as
Parquet and read again as the next one's input.  Stages 1 to 4 return the
columns of ``documents``; the last returns the encoded corpus.  Nulls, empty
and very long texts, ties, repeated rows, empty tables and extra columns are
treated as the operators' modules say; a null or empty text fails the quality
rules.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barquality.llm import langid, mixing, ngram_join, quality, sentencepiece
from barquality.llm.common import shared_dir

TOKENIZERS = os.environ.get("BARQUALITY_TOKENIZERS", "/opt/tokenizers")


#: Rows that go to Python workers at a time: documents are wide, and workers share an executor's memory.
ROWS_AT_A_TIME = 512


def _narrow(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS_AT_A_TIME:
        spark.conf.set(key, str(ROWS_AT_A_TIME))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the base rules and the compression bands."""
    _narrow(spark)
    return quality.keep(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known and not ambiguous; trained on a bounded labelled sample."""
    _narrow(spark)
    return langid.confident(docs, langid.train(docs, F.lit(True)))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its five-word shingles."""
    _narrow(spark)
    return ngram_join.drop_similar(docs, words=5, percent=80)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.repeat(docs, weights=(1, 2, 3), epochs=3)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, n_pieces, n_byte_pieces, ids_sha256, round_trip, ids of each row."""
    _narrow(spark)
    return sentencepiece.digests(docs, f"{TOKENIZERS}/piece_bpe_32k.model")


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("mixing", mixing_sources),
    ("sentencepiece", sentencepiece_encoding),
]

#: Compression ratios and piece ids are beyond SQL; tests compare the rows with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
