import pytest
from pyspark.sql import functions as F

from fewlabel.operators import screening as R
from fewlabel.plans.screening import spec_enumerate


def test_budget_best_fixture(spark):
    scaling = spark.createDataFrame([("f", "mse", 0, 1.0), ("f", "mse", 100, 0.5), ("f", "mse", 250, 0.4)], "feature string, training_objective string, s long, ifvar double")
    direct = spark.createDataFrame([("f", 1.0)], "feature string, direct_ifvar double")
    row = R.budget_best(scaling, direct, [500]).first()
    assert row["wins"] and row["best_s"] == 100 and row["variance_ratio_vs_direct"] == pytest.approx(0.625)


def test_budget_rows_fixture(spark):
    df = spark.createDataFrame([(200, 0.6, 1.0, 1.2)], "s long, ifvar double, direct_ols_ifvar double, zero_ifvar double")
    got = {r["budget"]: r for r in R.budget_rows(df, [100, 500, 1000]).collect()}
    assert set(got) == {500, 1000}
    assert got[500]["ratio_vs_direct_ols"] == pytest.approx(1.0) and not got[500]["beats_direct_ols"]
    assert got[1000]["ratio_vs_direct_ols"] == pytest.approx(0.75) and got[1000]["beats_direct_ols"]


def test_threshold_reports_budgets_without_feasible_size(spark):
    df = spark.createDataFrame([("a", 0, 100, 1.0, 0.9), ("a", 0, 400, 1.0, 0.5)], "spec_id string, replication long, s long, ifvar double, ifvar_ratio_to_s0 double")
    got = {r["budget"]: r for r in R.budget_threshold(df, ["spec_id"], [50, 200, 1000]).collect()}
    assert got[50]["best_s"] is None and not got[50]["wins"]
    assert not got[200]["wins"] and got[200]["best_s"] == 100
    assert got[1000]["wins"] and got[1000]["best_s"] == 400


def test_spec_ids(spark):
    specs = spec_enumerate(spark, ["A", "B"], ["A", "B", "C"], ["A", "C"], [1, 2])
    got = {(r["spec_id"], r["family"]) for r in specs.collect()}
    assert {"A", "A__B", "A__C", "B__A", "B__C", "B__A__C"} <= {s for s, _ in got}
    assert ("B__A__C", "final_controls") in got


def test_first_rows_of_a_group(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2)], "g string, v int")
    assert sorted((r["g"], r["v"]) for r in R.top_per_group(df, ["g"], [F.col("v")]).collect()) == [("a", 1), ("b", 2)]


def test_text_surrogate_beats_the_constant(spark):
    from fewlabel.operators import splits as X
    from fewlabel.operators import terms as TM
    from fewlabel.plans.surrogates import parse_method, surrogate_scaling

    rows = [
        (i, ("bright plum finish long " if i % 2 else "thin sour short dull ") + ("oak" if i % 3 else "citrus"), 1.0 if i % 2 else -1.0)
        for i in range(120)
    ]
    docs = spark.createDataFrame(rows, "id long, text string, y double").withColumn("terms", TM.terms(F.col("text")))
    counts = TM.term_counts(docs, "id", "terms")
    vocab = TM.vocabulary(counts, 120, 50, 3)
    assert vocab.orderBy("idx").first()["idx"] == 0
    sparse = TM.tfidf(counts, "id", vocab)
    norms = sparse.select(F.aggregate("val", F.lit(0.0), lambda s, v: s + v * v).alias("n")).collect()
    assert all(abs(r["n"] - 1) < 1e-9 for r in norms)
    base = docs.select("id", "y", F.lit(0.0).alias("base"), F.array(F.lit(1.0) + F.col("id") % 3).alias("a")).join(sparse, "id")
    members = X.pool_stop_scale_split(docs.select("id"), "id", [0], 60, 30, 30, seed=2).join(base, "id")
    out = surrogate_scaling(members, ["f"], vocab.count(), [0, 20, 60], [0.1, 1.0])
    got = {(r["s"], r["training_objective"]): r for r in out.collect()}
    assert len(got) == 1 + 2 * 4
    for (s, objective), r in got.items():
        if s > 0:
            assert r["ifvar"] < 0.5 * got[(0, "constant")]["ifvar"] and r["ifvar_ratio_to_s0"] < 0.5
    assert parse_method("mine:if_mse:ifvar").weighted
    with pytest.raises(ValueError):
        parse_method("mine")


def test_frequent_and_rare_words_are_averaged_alike(spark):
    import math

    from fewlabel.operators.terms import corpus_zipf

    rows = [(i, ["the"] * 30 + [f"w{i}", "plum"]) for i in range(400)] + [(999, [])]
    got = {r["id"]: r for r in corpus_zipf(spark.createDataFrame(rows, "id long, w array<string>"), "id", "w").collect()}
    total = 400 * 32
    z = {"the": math.log10(1e9 * 12000 / total), "plum": math.log10(1e9 * 400 / total), "w": math.log10(1e9 / total)}
    assert got[5]["common_zipf"] == pytest.approx((30 * z["the"] + z["plum"] + z["w"]) / 32)
    assert got[5]["content_common_zipf"] == pytest.approx((z["plum"] + z["w"]) / 2)
    assert got[999]["common_zipf"] == 0.0 and got[999]["rare_word_share"] == 0.0


def test_targets_of_every_priority_and_a_flat_one(spark):
    """Equal coefficients and weights are ordered by priority; a target without spread is not stable and comes last."""
    from fewlabel.operators.screening import rank_targets

    names = ("delta_log_sentences", "delta_log_length", "delta_prompt_coverage", "delta_format")
    rows = [("controlled", f"{n}_scale", 0.5, 0.4, 3.0, 20.0) for n in names]
    rows += [("controlled", "delta_other_scale", 0.0, 0.0, 0.0, None), ("marginal", "delta_format_scale", 0.5, 9.0, 3.0, 1.0)]
    df = spark.createDataFrame(rows, "model string, target string, nonzero_share double, abs_beta double, if_weight_p99 double, hessian_condition double")
    got = [(r["target"], r["priority"], r["stable"]) for r in rank_targets(df).orderBy("rank").collect()]
    assert got == [
        ("delta_format_scale", 0, True), ("delta_prompt_coverage_scale", 1, True), ("delta_log_length_scale", 2, True),
        ("delta_log_sentences_scale", 9, True), ("delta_other_scale", 9, False),
    ]
