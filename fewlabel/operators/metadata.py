"""Feature metadata: family, note and priority from ordered name rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The first family with a matching name part wins.
FAMILY_PARTS = (
    ("readability_length", ("length", "word_count", "char_count", "sentence", "read", "fk", "simplicity")),
    ("sentiment", ("vader", "emotion", "negation", "surprise")),
    ("context_alignment", ("coverage", "jaccard", "context")),
    ("specificity_commonness", ("common", "rare", "zipf", "content_word")),
    ("curiosity_style", ("question", "numeric", "second_person", "demonstrative", "curiosity", "superlative", "urgency")),
    ("format_emphasis", ("punctuation", "colon", "quote", "uppercase", "exclamation")),
)
TOP_PRIORITY = (
    "context_coverage", "context_jaccard", "vader_intensity", "vader_neg", "rare_word_share", "curiosity_style",
)
CUE_FAMILIES = ("sentiment", "context_alignment", "specificity_commonness", "curiosity_style")
# Notes are ours in wording; they only label report rows.
NAME_NOTES = (
    ("context_coverage", "Share of headline content words that the context repeats."),
    ("context_jaccard", "Overlap of the distinct content words of headline and context."),
    ("common_zipf", "Mean corpus frequency of the words; high means plain language."),
    ("content_common_zipf", "Mean corpus frequency of the content words."),
    ("rare_word_share", "Share of uncommon content words."),
    ("curiosity_style", "Sum of question, address and curiosity cues."),
)
FAMILY_NOTES = (
    ("readability_length", "Length or readability of the headline."),
    ("format_emphasis", "Punctuation or emphasis in the headline."),
)


def feature_family(name: Column) -> Column:
    family = F.lit("other")
    for label, parts in reversed(FAMILY_PARTS):
        hit = name.contains(parts[0])
        for p in parts[1:]:
            hit = hit | name.contains(p)
        family = F.when(hit, F.lit(label)).otherwise(family)
    return family


def feature_note(name: Column, family: Column) -> Column:
    note = F.lit("Headline cue computed from the text.")
    for label, words in reversed(FAMILY_NOTES):
        note = F.when(family == label, F.lit(words)).otherwise(note)
    note = F.when(name.startswith("vader_"), F.lit("Lexicon sentiment of the headline.")).otherwise(note)
    for label, words in reversed(NAME_NOTES):
        note = F.when(name == label, F.lit(words)).otherwise(note)
    return note


def feature_priority(name: Column, family: Column) -> Column:
    return (
        F.when(name.isin(*TOP_PRIORITY), 0)
        .when(family.isin(*CUE_FAMILIES), 1)
        .when(family == "readability_length", 2)
        .otherwise(3)
    )


# Families of the single-text screening features by name prefix.
TEXT_FAMILIES = (
    ("feat_log_price", "price", 0),
    ("feat_country_", "country", 1),
    ("feat_variety_", "variety", 1),
    ("feat_log_word_count", "text_length", 2),
    ("feat_reading_ease", "readability", 1),
    ("feat_vader_", "sentiment", 1),
)


def text_feature_family(name: Column) -> tuple[Column, Column]:
    """Family and priority of the single-text features."""
    family, priority = F.lit("other"), F.lit(3)
    for prefix, label, rank in TEXT_FAMILIES:
        hit = name.startswith(prefix)
        family = F.when(hit, F.lit(label)).otherwise(family)
        priority = F.when(hit, F.lit(rank)).otherwise(priority)
    return family, priority


def family_kind_counts(meta: DataFrame) -> DataFrame:
    return meta.groupBy("family", "kind").agg(F.count(F.lit(1)).alias("n_features")).orderBy("family", "kind")


def name_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per named column of ``df`` (a fixed, small table)."""
    spark = df.sparkSession
    return spark.createDataFrame([(i, c) for i, c in enumerate(columns)], "position int, feature string")
