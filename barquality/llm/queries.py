"""One query per operator over its whole table, and the SQL that gives the same rows."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, codebooks, fingerprints, html_extract, langid, licenses, lm, mixing, ngram_join, oracles, preference, quality, sentencepiece, urls

#: The folder of public vocabulary files; a parameter, not part of the package.
TOKENIZERS = os.environ.get("BARQUALITY_TOKENIZERS", "/opt/tokenizers")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.jaccard_components(_table(spark, sf_dir, "documents"), words=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), weights=(1, 2, 3), epochs=3)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(_table(spark, sf_dir, "documents"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages")).drop("n_candidates")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = langid.held_out("doc_id", 7, 2)
    return lm.train_and_score(docs, ~held_out, held_out)


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, pairs = preference.borrowed_ends(_table(spark, sf_dir, "conversations"))
    return preference.digests(preference.format_pairs(turns, pairs)).drop("chosen_id", "rejected_id")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.digests(_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = langid.held_out("doc_id", 5, 0)
    predicted = langid.predict(docs, langid.train(docs, ~held_out))
    return predicted.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.compress(_table(spark, sf_dir, "embeddings"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_ngram_jaccard_join, op3_mixing, op4_fingerprints, op5_url_filters,
        op6_lm_scoring, op7_chat_formatting, op8_html_extraction, op9_sentencepiece, op10_language_id,
        op11_centroid_clustering, op12_vector_codes, op13_license_scan, pipeline,
    )
}

#: The other operators use codecs, hashes, parsers or models that SQL lacks; tests hold them against plain versions.
ORACLES: dict[str, str] = {
    "op2_ngram_jaccard_join": oracles.OP2,
    "op3_mixing": oracles.OP3,
    "op5_url_filters": oracles.OP5,
    "op7_chat_formatting": oracles.OP7,
    "op11_centroid_clustering": oracles.OP11,
    "op12_vector_codes": oracles.OP12,
    "op13_license_scan": oracles.OP13,
}
