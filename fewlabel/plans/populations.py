"""Populations the experiments run on, built from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.hashing import hash_key
from ..operators.population import clean_population, first_ids


def document_features(documents: DataFrame) -> DataFrame:
    """Narrow feature rows per distinct text: the text itself is not shuffled.

    Features are computed while scanning; only then are copies merged on the
    hash of the text, so rows of about a hundred bytes cross the network.
    """
    w = documents.where(F.col("text").isNotNull()).withColumn("w", T.words(F.col("text")))
    rows = w.select(
        F.sha2("text", 256).alias("h"),
        F.col("doc_id").alias("id"),
        "lang",
        "source",
        "n_chars",
        F.size("w").alias("n"),
        T.sentence_runs(F.col("text")).alias("s"),
        T.syllable_total(F.col("w")).alias("syl"),
    ).select(
        "h",
        "id",
        "lang",
        "source",
        "n_chars",
        F.log1p("n").alias("x1"),
        (T.reading_ease(F.col("n"), F.col("s"), F.col("syl")) / 100).alias("x2"),
    )
    others = [c for c in rows.columns if c not in ("h", "id")]
    merged = rows.groupBy("h").agg(F.min("id").alias("id"), *[F.min_by(c, "id").alias(c) for c in others])
    return merged.drop("h")


def document_population(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Distinct texts with features; y is null where there is no label."""
    y = labels.select(
        F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("y"), F.col("toxic").cast("double").alias("toxic")
    )
    return document_features(documents).join(y, "id", "left")


def labelled_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return document_population(documents, labels).where(F.col("y").isNotNull())


def labelled_texts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, text, y) of labelled distinct texts, for the text surrogates."""
    texts = documents.select(F.col("doc_id").alias("id"), "text").where(F.col("text").isNotNull())
    y = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("y")).where(F.col("y").isNotNull())
    # narrow rows decide which documents are wanted before any text moves
    wanted = y.join(first_ids(texts, "text", "id"), "id", "left_semi")
    # the narrow rows are hashed and the texts stream by: they are never sorted
    return texts.join(wanted.hint("shuffle_hash"), "id")


def order_population(lineitem: DataFrame) -> DataFrame:
    """One row per order: value y, number of lines x1, total quantity x2."""
    return lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(
        (F.sum("l_extendedprice") / 1000).alias("y"),
        F.count(F.lit(1)).cast("double").alias("x1"),
        (F.sum("l_quantity") / 10).alias("x2"),
    )


def document_pairs(documents: DataFrame) -> DataFrame:
    """Wide pair table: documents 2k and 2k+1, each the other's excerpt."""
    half = F.floor(F.col("doc_id") / 2)
    even = documents.where(F.col("doc_id") % 2 == 0).select(
        half.alias("pair_id"), F.col("text").alias("headline_a"), F.col("source").alias("lede_a")
    )
    odd = documents.where(F.col("doc_id") % 2 == 1).select(
        half.alias("pair_id"), F.col("text").alias("headline_b"), F.col("source").alias("lede_b")
    )
    both = even.join(odd, "pair_id")
    return both.withColumn("excerpt_a", F.col("headline_b")).withColumn("excerpt_b", F.col("headline_a"))


def preference_pairs(conversations: DataFrame) -> DataFrame:
    """First user turn as prompt, first two assistant turns as responses.

    The turns are found on narrow (conversation, turn) rows with grouped
    minima; one join and one aggregate per conversation then fetch the texts.
    """
    turns = conversations.select("conv_id", "turn", "role")
    first = turns.groupBy("conv_id").agg(
        F.min(F.when(F.col("role") == "user", F.col("turn"))).alias("t0"),
        F.min(F.when(F.col("role") == "assistant", F.col("turn"))).alias("t1"),
    )
    later = turns.where(F.col("role") == "assistant").join(first, "conv_id").where(F.col("turn") > F.col("t1"))
    second = later.groupBy("conv_id").agg(F.min("turn").alias("t2"), F.min("t0").alias("t0"), F.min("t1").alias("t1"))
    named = {"t0": "prompt", "t1": "response_1", "t2": "response_2"}
    texts = conversations.select("conv_id", "turn", "text").join(second.where(F.col("t0").isNotNull()), "conv_id")
    texts = texts.where(F.col("turn").isin(*[F.col(k) for k in named]))
    out = texts.groupBy("conv_id").agg(*[F.max(F.when(F.col("turn") == F.col(k), F.col("text"))).alias(n) for k, n in named.items()])
    gap = (F.length("response_2") - F.length("response_1")) / F.lit(300.0)
    fold = F.conv(F.substring(hash_key(7, "split", F.col("conv_id")), 1, 15), 16, 10).cast("long")
    return out.withColumns(
        {
            "preference_strength": F.greatest(F.lit(-3.0), F.least(F.lit(3.0), F.bround(gap, 0))),
            "split": F.when(F.pmod(fold, F.lit(5)) == 0, "validation").otherwise("train"),
        }
    )
