"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontamination, hard_negatives, html_extract, language_id, line_dedup, lm_score, mixing, periodic_runs, quality_classifier, quality_rules, secret_scan, simhash

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


@_query
def op2_decontamination(spark, sf_dir):
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query
def op3_html_extraction(spark, sf_dir):
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


@_query
def op4_language_id(spark, sf_dir):
    return language_id.predict(_table(spark, sf_dir, "documents"))


@_query
def op5_quality_classifier(spark, sf_dir):
    return quality_classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op6_secret_scan(spark, sf_dir):
    return secret_scan.find_secrets(_table(spark, sf_dir, "documents"))


@_query
def op7_lm_score(spark, sf_dir):
    return lm_score.score_documents(_table(spark, sf_dir, "documents"))


@_query
def op8_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"))


@_query
def op9_source_mixing(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count().alias("size"))
    mixed = mixing.mix(docs)
    return mixed.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken")


@_query
def op10_line_dedup(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.dedup_lines(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@_query
def op11_hard_negatives(spark, sf_dir):
    vectors = hard_negatives.integer_vectors(hard_negatives.relabelled(_table(spark, sf_dir, "embeddings")))
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 50 == 0)


@_query
def op12_periodic_runs(spark, sf_dir):
    docs = periodic_runs.planted(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return periodic_runs.digests(periodic_runs.periodic_runs(docs))


@_query
def op13_byte_bpe(spark, sf_dir):
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = byte_bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern).drop("text")
    return byte_bpe.decode(encoded, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


ORACLES["op9_source_mixing"] = mixing.MIX_SQL
ORACLES["op11_hard_negatives"] = hard_negatives.SQL
ORACLES["op10_line_dedup"] = """
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS line, unnest(parts) AS value
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, translate(regexp_replace(regexp_replace(value, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), owners AS (
  SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key
), judged AS (
  SELECT k.doc_id, k.line, k.value, coalesce(o.owner < k.doc_id, false) AS dropped
  FROM keyed k LEFT JOIN owners o ON k.key = o.key
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(value, chr(10) ORDER BY line) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
