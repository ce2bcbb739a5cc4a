"""Quality rules with adaptive thresholds, in native column expressions only.

Per document a few measures; per language and source a quantile sketch of each
(``percentile_approx``: partial sketches are merged, whatever the size of a
group); a document fails if a measure lies beyond a fence of its group, a
quantile of the group's tail: above for shares of symbols and repetitions, on
both sides for the number of words and their mean length. Where more than the
tail stands out, shares also fail beyond the upper quartile plus ``REACH``
times the spread between quartiles. Groups with few
documents use the fences of their language, those without one the fences of
all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import SPACES, WORD, words_of

# Parameters: sketch accuracy, reach of the second fence in spreads, least documents of a group.
ACCURACY = 10_000
REACH = 8.0
MIN_GROUP = 40
# Measures with the quantiles of their lower and upper fences.
MEASURES = {
    "symbol_share": (None, 0.99),
    "dup_line_share": (None, 0.99),
    "repeat_share": (None, 0.99),
    "n_words": (0.0085, 0.9915),
    "mean_word_length": (0.0085, 0.9915),
}
# Shares with the least spread their second fence allows for.
SHARES = {"symbol_share": 0.01, "dup_line_share": 0.05, "repeat_share": 0.05}
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def _windows(hashes: Column) -> Column:
    """Hashes of all windows of three words, from the words' hashes."""
    return F.when(
        F.size(hashes) >= 3,
        F.transform(
            F.slice(hashes, F.lit(1), F.size(hashes) - 2),
            lambda h, i: F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def measures(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source) with the counts of the contract and the shares; null texts have no words."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    step = docs.select("doc_id", "lang", "source", words_of(F.col("text")).alias("w"), lines.alias("l"), F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"))
    step = step.select(
        "doc_id", "lang", "source", "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("l").cast("long").alias("n_text_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    # windows are sorted with their places, so equal ones are neighbours: every step is
    # linear or n log n in the length of the document, and texts without any stop here
    step = step.withColumn("g", _windows(F.col("h"))).drop("h")
    placed = F.array_sort(F.transform("g", lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
    step = step.withColumn("s", F.when(F.size(F.array_distinct("g")) < F.size("g"), placed)).drop("g")
    twice = F.filter("s", lambda x, i: (x["g"] == F.get("s", i + 1)["g"]) | (x["g"] == F.get("s", i - 1)["g"]))
    step = step.withColumn("p", F.transform(twice, lambda x: x["i"])).drop("s")
    covered = F.array_distinct(F.concat("p", F.transform("p", lambda x: x + 1), F.transform("p", lambda x: x + 2)))
    step = step.withColumn("n_repeat_words", F.when(F.col("p").isNull(), 0).otherwise(F.size(covered)).cast("long")).drop("p")

    def share(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))

    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return step.withColumns(
        {
            "base_failed": failed,
            "symbol_share": share("n_symbols", "word_chars"),
            "dup_line_share": share("n_dup_lines", "n_text_lines"),
            "repeat_share": share("n_repeat_words", "n_words"),
            "mean_word_length": share("word_chars", "n_words"),
        }
    )


def _fences(measured: DataFrame, keys: list[str], least: int) -> DataFrame:
    places = {m: [0.25, 0.75, tails[1]] if m in SHARES else [*tails] for m, tails in MEASURES.items()}
    aggregates = [F.count("*").alias("n"), *[F.percentile_approx(m, p, ACCURACY).alias(m) for m, p in places.items()]]
    rows = measured.groupBy(*keys).agg(*aggregates).where(F.col("n") >= least)
    tag = "_".join(keys) or "all"
    fences = []
    for m in MEASURES:
        at = [F.get(F.col(m), F.lit(i)) for i in range(3)]
        if m in SHARES:
            spread = at[1] + REACH * F.greatest(at[1] - at[0], F.lit(SHARES[m]))
            fences.append(F.array(F.least(at[2], spread)).alias(f"{m}__{tag}"))
        else:
            fences.append(F.col(m).alias(f"{m}__{tag}"))
    return rows.select(*[F.col(k).alias(f"{k}__{tag}") for k in keys], *fences)


def quality_rules(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """Counts, shares, ``base_failed`` and ``kept`` for every row of ``docs(doc_id, text, lang, source)``.

    Fences are taken over the documents that pass the base rule. Null languages
    and sources are groups of their own, null doc_ids and repeated rows are
    judged like others, ties with a fence stay. An empty table gives an empty
    result. Further columns are ignored.
    """
    measured = materialise(measures(docs), "quality-measures")
    passed = measured.where("not base_failed")
    both, lang, every = (_fences(passed, k, n) for k, n in ((["lang", "source"], min_group), (["lang"], min_group), ([], 1)))
    joined = measured.join(
        both, F.col("lang").eqNullSafe(F.col("lang__lang_source")) & F.col("source").eqNullSafe(F.col("source__lang_source")), "left"
    )
    joined = joined.join(lang, F.col("lang").eqNullSafe(F.col("lang__lang")), "left").join(F.broadcast(every), F.lit(True), "left")
    within = F.lit(True)
    for m, (low, _) in MEASURES.items():
        fence = F.coalesce(f"{m}__lang_source", f"{m}__lang", f"{m}__all")
        inside = F.col(m) <= F.get(fence, F.lit(0 if low is None else 1))
        if low is not None:
            inside = inside & (F.col(m) >= F.get(fence, F.lit(0)))
        within = within & F.coalesce(inside, F.lit(True))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & within).alias("kept"),
        *SHARES,
    )
