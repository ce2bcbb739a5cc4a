"""Preference pairs: response features, deltas (2 minus 1) and pair texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import words as V
from ..operators.scaling import scale_no_center
from ..sources.tables import require_columns

DELTAS = ("delta_log_length", "delta_prompt_coverage", "delta_format", "delta_log_sentences")


def response_features(
    pairs: DataFrame, keep_stop: bool = False, stop: Sequence[str] = V.STOP_WORDS
) -> DataFrame:
    """Counts, coverage and layout flag per response; rows with nulls are dropped."""
    needed = ["prompt", "response_1", "response_2", "preference_strength"]
    rows = require_columns(pairs, needed).na.drop(subset=needed)
    sets = rows.withColumns(
        {
            "__p": F.array_distinct(T.tokens(F.col("prompt"), keep_stop, stop)),
            "__1": T.tokens(F.col("response_1"), keep_stop, stop),
            "__2": T.tokens(F.col("response_2"), keep_stop, stop),
        }
    )
    out = {}
    for i in (1, 2):
        r = F.col(f"response_{i}")
        out[f"response_{i}_word_count"] = T.token_count(r).cast("double")
        out[f"response_{i}_sentence_count"] = T.sentence_runs(r).cast("double")
        out[f"response_{i}_prompt_coverage"] = T.coverage(F.col("__p"), F.col(f"__{i}"))
        out[f"response_{i}_format"] = T.structured_format(r)
    out["y_preference_strength"] = F.col("preference_strength").cast("double")
    return sets.withColumns(out).drop("__p", "__1", "__2")


def response_delta(features: DataFrame, zero_sd: str = "zero") -> DataFrame:
    """Response 2 minus response 1, and each delta over its population sd."""

    def diff(name: str, log: bool = False) -> Column:
        two, one = F.col(f"response_2_{name}"), F.col(f"response_1_{name}")
        return F.log1p(two) - F.log1p(one) if log else two - one

    raw = features.withColumns(
        {
            "delta_log_length": diff("word_count", log=True),
            "delta_prompt_coverage": diff("prompt_coverage"),
            "delta_format": diff("format"),
            "delta_log_sentences": diff("sentence_count", log=True),
        }
    )
    return scale_no_center(raw, {f"{d}_scale": d for d in DELTAS}, zero_sd)


# The wording of the pair prompt.
PAIR_TEMPLATE = (
    "Task: Predict the human preference strength for Candidate B over Candidate A.\n\n"
    "Prompt:\n%s\n\nCandidate A:\n%s\n\nCandidate B:\n%s\n\n"
    "Preference strength for Candidate B over Candidate A:"
)
RESPONSE_TEMPLATE = "Prompt:\n%s\n\nResponse:\n%s"
HEADLINE_TEMPLATE = "Headline A: %s\nHeadline B: %s\nContext: %s"


def pair_text(df: DataFrame) -> DataFrame:
    """Forward and swapped candidate order, and one text per response."""
    require_columns(df, ["prompt", "response_1", "response_2"])
    return df.withColumns(
        {
            "forward": F.format_string(PAIR_TEMPLATE, "prompt", "response_1", "response_2"),
            "swapped": F.format_string(PAIR_TEMPLATE, "prompt", "response_2", "response_1"),
            "text_1": F.format_string(RESPONSE_TEMPLATE, "prompt", "response_1"),
            "text_2": F.format_string(RESPONSE_TEMPLATE, "prompt", "response_2"),
        }
    )


def headline_text(a: Column, b: Column, context: Column) -> Column:
    return F.format_string(HEADLINE_TEMPLATE, T.text_or_empty(a), T.text_or_empty(b), context)


def preference_summary(frame: DataFrame) -> DataFrame:
    """Rows, outcome range and rows per split in one map column."""
    per_split = frame.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.min("y_preference_strength").alias("lo"),
        F.max("y_preference_strength").alias("hi"), F.sum("y_preference_strength").alias("total"),
    )
    return per_split.agg(
        F.sum("n").alias("n_rows"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("split", "n")))).alias("split_counts"),
        F.min("lo").alias("y_min"),
        F.max("hi").alias("y_max"),
        (F.sum("total") / F.sum("n")).alias("y_mean"),
    )
