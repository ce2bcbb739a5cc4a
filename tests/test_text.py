import math
import random
import re

import pytest
from pyspark.sql import functions as F

from fewlabel.functions import text as T
from fewlabel.operators.scaling import antisymmetric_score, pair_embedding
from fewlabel.plans import preference as PREF


def one(spark, text, build):
    return spark.createDataFrame([(text,)], "t string").select(build(F.col("t")).alias("x")).first()["x"]


def slow_syllables(word):
    z = re.sub("[^a-z]", "", word.lower())
    if not z:
        return 0
    groups = len(re.findall("[aeiouy]+", z))
    return max(1, groups - (1 if z.endswith("e") and groups > 1 else 0))


def test_whole_text_syllables_equal_word_by_word(spark):
    rng = random.Random(1)
    texts = []
    for _ in range(200):
        words = ["".join(rng.choice("aeiouybcrstnlm") for _ in range(rng.randint(1, 9))) for _ in range(12)]
        words += ["don't", "able", "the", "queue", "hmm", "Eye"]
        texts.append(" ".join(words))
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.syllable_total(T.words(F.col("t"))).alias("n"))
    for r in df.collect():
        assert r["n"] == sum(slow_syllables(w) for w in re.findall(r"[A-Za-z]+(?:'[A-Za-z]+)?", r["t"]))


def test_long_runs_do_not_stall(spark):
    for text in ("a" * 200_000, "b" * 200_000, "ab" * 100_000, "\n" * 100_000, "*" * 100_000):
        assert one(spark, text, lambda t: T.syllable_total(T.words(t)) + T.structured_format(t).cast("int")) >= 0


@pytest.mark.parametrize("text,flag", [("1. one\n2. two", 1.0), ("- a\n- b", 1.0), ("**bold** text", 1.0), ("plain text", 0.0), ("# head", 1.0), ("Some label:\nbody", 1.0)])
def test_format(spark, text, flag):
    assert one(spark, text, T.structured_format) == flag


def test_sentences(spark):
    assert one(spark, "One. Two! ...  ", T.sentence_parts) == 2
    assert one(spark, "", T.sentence_parts) == 1
    assert one(spark, "One. Two! ...  ", T.sentence_runs) == 3


def test_headline_words(spark):
    assert one(spark, "The 1st 2,000 DON'T 42", T.headline_words) == ["the", "1st", "don't"]


def test_normalize_and_slug(spark):
    assert one(spark, "  a\u00a0 b\n c ", T.normalize_text) == "a b c"
    assert one(spark, "Bordeaux-style Red!", T.slug) == "bordeaux_style_red"


def pairs(spark, swapped=False):
    rows = [("all", "How do I keep users?", "Keep users.", "- Keep users\n- Ask users\n- Learn why users leave.", 2.0), ("all", "Explain churn", "Long answer. With two parts!", "Short", -1.0)]
    if swapped:
        rows = [(s, p, b, a, -y) for s, p, a, b, y in rows]
    return spark.createDataFrame(rows, "split string, prompt string, response_1 string, response_2 string, preference_strength double")


def test_preference_signs_and_antisymmetry(spark):
    here = PREF.response_delta(PREF.response_features(pairs(spark))).orderBy("prompt").collect()
    there = PREF.response_delta(PREF.response_features(pairs(spark, True))).orderBy("prompt").collect()
    row = next(r for r in here if r["preference_strength"] == 2)
    assert row["y_preference_strength"] == 2 and row["delta_log_length"] > 0 and row["delta_format"] == 1
    for a, b in zip(here, there):
        for d in PREF.DELTAS:
            assert math.isclose(a[d], -b[d], abs_tol=1e-12) and math.isclose(a[f"{d}_scale"], -b[f"{d}_scale"], abs_tol=1e-12)


def test_coverage(spark):
    df = spark.createDataFrame([("keep users happy", "users stay"), ("", "x")], "p string, r string")
    got = [r["c"] for r in df.select(T.coverage(T.tokens(F.col("p")), T.tokens(F.col("r"))).alias("c")).collect()]
    assert got == [pytest.approx(1 / 3), 0.0]


def test_pair_text_orders(spark):
    row = PREF.pair_text(pairs(spark)).where("prompt = 'Explain churn'").first()
    assert "Candidate A:\nLong answer" in row["forward"] and "Candidate B:\nShort" in row["forward"]
    assert "Candidate A:\nShort" in row["swapped"]


def test_pair_embeddings(spark):
    df = spark.createDataFrame([([1.0, 2.0], [4.0, 1.0]), ([3.0, 1.0], [2.0, 5.0])], "a array<double>, b array<double>")
    got = df.select(pair_embedding(F.col("a"), F.col("b")).alias("d")).collect()
    assert [r["d"] for r in got] == [[3.0, -1.0], [-1.0, 4.0]]
    both = df.select(pair_embedding(F.col("a"), F.col("b"), "a_minus_b", absolute=True).alias("d")).first()["d"]
    assert both == [-3.0, 1.0, 3.0, 1.0]
    bad = spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="sizes differ"):
        bad.select(pair_embedding(F.col("a"), F.col("b"))).collect()


def test_antisymmetric_scores(spark):
    df = spark.createDataFrame([(3.0, 1.0), (-2.0, 4.0), (0.5, -0.5)], "f double, g double")
    assert [r[0] for r in df.select(antisymmetric_score(F.col("f"), F.col("g"))).collect()] == [1.0, -3.0, 0.5]


def test_headline_features_cover_the_families(spark):
    from fewlabel.plans import headlines as H

    df = spark.createDataFrame(
        [
            (1, "Why you will love this!", "Cats sleep", "cats love to sleep", "a story about cats", "s", None),
            (2, "10 TERRIBLE ideas", "Is it good?", "bad plans", None, "x", "y"),
        ],
        "pair_id long, headline_a string, headline_b string, excerpt_a string, excerpt_b string, lede_a string, lede_b string",
    )
    features = H.arm_features(H.arms(df))
    deltas, meta = H.pair_deltas(features)
    families = {r["family"] for r in meta.collect()}
    assert families >= {"readability_length", "sentiment", "context_alignment", "specificity_commonness", "curiosity_style", "format_emphasis"}
    row = deltas.where("pair_id = 1").first()
    assert row["delta_question_raw"] == 1.0 and row["delta_exclamation_count_raw"] == 1.0 and row["delta_vader_compound_raw"] > 0
    assert meta.count() == 42
