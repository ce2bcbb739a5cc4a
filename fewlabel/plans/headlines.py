"""Headline pairs: arm features, deltas (a minus b), metadata, text surrogate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import words as V
from ..operators import metadata as M
from ..operators.moments import collect_moments, gram_vectors
from ..operators.population import context_concat
from ..operators.scaling import feature_kinds, scale_no_center
from ..operators.surrogate import ridge_path
from ..operators.terms import corpus_zipf, lexicon_sentiment, term_counts, terms, tfidf, vocabulary
from ..session import materialise
from .preference import headline_text


def arms(pairs: DataFrame, id_: str = "pair_id") -> DataFrame:
    """Long form: one row per arm with its headline and context."""
    both = F.array(
        *[
            F.struct(
                F.lit(a).alias("arm"),
                T.text_or_empty(F.col(f"headline_{a}")).alias("text"),
                context_concat(pairs, a).alias("context"),
            )
            for a in ("a", "b")
        ]
    )
    long = pairs.select(id_, F.explode(both).alias("x")).select(id_, "x.*")
    return long.withColumn("arm_id", F.concat_ws(":", F.col(id_).cast("string"), "arm"))


def arm_features(long: DataFrame, id_: str = "pair_id", lexicon: DataFrame | None = None) -> DataFrame:
    """All headline features per arm; the result is narrow and holds no text."""
    text = F.col("text")
    base = long.withColumns(
        {
            "tokens": T.headline_tokens(text),
            "c": T.without(T.headline_words(F.col("context")), V.STOP_WORDS),
        }
    )
    base = base.withColumn("w", F.filter("tokens", lambda t: t.rlike("[a-z]")))
    base = base.withColumns({"k": T.without(F.col("w"), V.STOP_WORDS), "n": F.size("w"), "s": T.sentence_parts(text), "syl": T.syllable_total(F.col("w"))})
    w, k, n = F.col("w"), F.col("k"), F.col("n")
    cols = {
        "question": T.question(text, w),
        "numeric": T.numeric(F.col("tokens")),
        "word_count": n.cast("double"),
        "log_word_count": F.log1p(n),
        "char_count": F.length(text).cast("double"),
        "log_char_count": F.log1p(F.length(text)),
        "avg_word_length": T.safe_div(T.letters_total(w), n),
        "sentence_count": F.col("s").cast("double"),
        "reading_ease": T.reading_ease(n, F.col("s"), F.col("syl")),
        "fk_grade": T.fk_grade(n, F.col("s"), F.col("syl")),
        "simplicity": -F.log1p(n) - T.safe_div(T.letters_total(w), n),
        "content_word_share": T.safe_div(F.size(k), n),
        "context_coverage": T.coverage(k, F.col("c")),
        "context_jaccard": T.jaccard(k, F.col("c")),
        "question_mark_count": T.occurrences(text, "?").cast("double"),
        "exclamation_count": T.occurrences(text, "!").cast("double"),
        "colon_dash_count": T.occurrences(text, ":-").cast("double"),
        "quote_count": T.occurrences(text, "\"'").cast("double"),
        "uppercase_word_share": T.safe_div(T.uppercase_words(text), n),
        "punctuation_intensity": T.punctuation_intensity(text),
    }
    cols |= {f"{name}_share": T.vocab_share(w, vocab) for name, vocab in V.VOCABULARIES.items()}
    cols |= {f"has_{name}": T.has_vocab(w, V.VOCABULARIES[name]) for name in ("second_person", "negation", "demonstrative")}
    out = base.select("arm_id", id_, "arm", "w", *[c.alias(name) for name, c in cols.items()])
    out = out.withColumn(
        "curiosity_style",
        F.col("question")
        + F.col("has_second_person")
        + F.col("has_demonstrative")
        + (F.col("curiosity_share") > 0).cast("double")
        + (F.col("surprise_share") > 0).cast("double"),
    )
    stored = materialise(out, "arms")
    zipf = corpus_zipf(stored, "arm_id", "w")
    mood = lexicon_sentiment(stored, "arm_id", "w", lexicon)
    mood = mood.select("arm_id", *[F.col(c).alias(f"vader_{c}") for c in mood.columns if c != "arm_id"])
    return stored.drop("w").join(zipf, "arm_id").join(mood, "arm_id")


def pair_deltas(features: DataFrame, id_: str = "pair_id") -> tuple[DataFrame, DataFrame]:
    """delta_f_raw and delta_f per pair, and one metadata row per feature."""
    names = [c for c in features.columns if c not in ("arm_id", id_, "arm")]
    sign = F.when(F.col("arm") == "a", 1.0).otherwise(-1.0)
    raw = features.groupBy(id_).agg(*[F.sum(sign * F.col(c)).alias(f"delta_{c}_raw") for c in names])
    stored = materialise(raw, "deltas")
    kinds = {r["feature"]: r["kind"] for r in feature_kinds(stored, [f"delta_{c}_raw" for c in names]).collect()}
    flat = [c for c in names if kinds[f"delta_{c}_raw"] == "continuous"]
    out = scale_no_center(stored, {f"delta_{c}": f"delta_{c}_raw" for c in flat}) if flat else stored
    rest = {f"delta_{c}": F.coalesce(F.col(f"delta_{c}_raw"), F.lit(0.0)) for c in names if c not in flat}
    out = out.withColumns(rest) if rest else out
    rows = [(c, kinds[f"delta_{c}_raw"]) for c in names]
    meta = features.sparkSession.createDataFrame(rows, "name string, kind string")
    meta = meta.withColumn("family", M.feature_family(F.col("name")))
    meta = meta.select(
        F.concat(F.lit("delta_"), "name").alias("feature"),
        F.concat(F.lit("delta_"), "name", F.lit("_raw")).alias("raw_column"),
        "family",
        "kind",
        M.feature_note(F.col("name"), F.col("family")).alias("note"),
        M.feature_priority(F.col("name"), F.col("family")).alias("priority"),
    )
    return out, meta


# The controls every candidate is screened against.
CORE_CONTROLS = (
    "delta_question", "delta_numeric", "delta_log_word_count", "delta_context_coverage",
    "delta_vader_compound", "delta_common_zipf", "delta_reading_ease", "delta_curiosity_style",
)
ALPHAS = (0.1, 1.0, 10.0, 100.0, 1000.0)


def tfidf_surrogate(
    rows: DataFrame, id_: str, text: str, y: str, max_features: int = 1000, min_df: int = 3, alphas: Sequence[float] = ALPHAS
) -> tuple[DataFrame, dict[str, float]]:
    """Ridge on TF-IDF fitted on h_scale rows, alpha by MSE on target rows; predictions for all.

    The moment matrix limits the vocabulary; fitting and judging read the rows
    once, in partial matrices per task.
    """
    docs = materialise(rows.select(id_, y, "split", terms(F.col(text)).alias("terms")), "terms")
    train = docs.where(F.col("split") == "h_scale")
    counts = term_counts(docs, id_, "terms")
    vocab = materialise(vocabulary(term_counts(train, id_, "terms"), train.count(), max_features, min_df), "vocabulary")
    p = vocab.count()
    weights = docs.select(id_, y, "split").hint("shuffle_hash").join(tfidf(counts, id_, vocab), id_, "left")
    empty = F.array().cast("array<int>"), F.array().cast("array<double>")
    weights = weights.withColumns({"idx": F.coalesce("idx", empty[0]), "val": F.coalesce("val", empty[1])})
    stored = materialise(weights, "tfidf")
    names = ["1", *[f"t{i}" for i in range(p)], "y"]
    z = stored.where(F.col("split").isin("h_scale", "target")).select("split", "idx", "val", F.col(y).alias("y"), F.lit(1.0).alias("w"))
    m = collect_moments(gram_vectors(z, p + 2, ["split"]), names, ["split"])
    beta, alpha, mse, _ = ridge_path(m[("h_scale",)], m[("target",)], names[1:-1], "y", alphas)
    coef = rows.sparkSession.createDataFrame([([float(b) for b in beta],)], "c array<double>").scalar()
    scored = stored.withColumn("__c", coef)
    dot = F.aggregate(
        F.zip_with("idx", "val", lambda i, v: F.get(F.col("__c"), i + 1) * v), F.get(F.col("__c"), F.lit(0)), lambda s, v: s + v
    )
    return scored.select(id_, dot.alias("pred")), {"tfidf_alpha": alpha, "tfidf_eval_mse": mse, "tfidf_n_features": float(p)}


def pair_surrogate_text(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("__text", headline_text(F.col("headline_a"), F.col("headline_b"), context_concat(pairs, "a")))
