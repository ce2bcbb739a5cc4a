"""Zero denominators, kinds, accents and pairs in the cases that data brings."""

import pytest
from pyspark.sql import functions as F

from fewlabel.functions import text as T
from fewlabel.operators import allocation as A
from fewlabel.operators import ppi as P
from fewlabel.operators import scaling as C
from fewlabel.operators import screening as R
from fewlabel.operators.population import clean_population
from fewlabel.plans import populations as POP


def test_a_zero_direct_variance_gives_no_win(spark):
    scaling = spark.createDataFrame([("f", "mse", s, 1.0 + s) for s in (10, 20)], "feature string, training_objective string, s long, ifvar double")
    direct = spark.createDataFrame([("f", 0.0)], "feature string, direct_ifvar double")
    got = R.budget_best(scaling, direct, [100]).collect()
    assert [(r["best_s"], r["variance_ratio_vs_direct"], r["wins"]) for r in got] == [(10, None, None)]


def test_equal_labels_give_no_ratio(spark):
    cells = spark.createDataFrame([(300, "m", 0.2, 0.5, 0.0), (300, "m", 0.2, 0.5, 1.0)], "budget long, method string, rho double, ppi_var_est double, sample_mean_var_est double")
    row = A.sample_savings(cells).first()
    assert row["var_reduction"] == pytest.approx(0.0) and row["mean_paired_reduction"] == pytest.approx(0.5)
    flat = A.sample_savings(cells.withColumn("sample_mean_var_est", F.lit(0.0))).first()
    assert flat["var_reduction"] is None and flat["mean_paired_reduction"] is None


def test_tuned_mean_without_unlabelled_rows(spark):
    rows = spark.createDataFrame([("g", 1.0, 0.5), ("g", 2.0, 1.5)], "g string, y double, f double")
    row = P.ppi_plus_plus(rows, ["g"], "y", "f", F.lit(True), F.lit(False)).first()
    assert row["n"] == 2 and row["n_unlabeled"] == 0 and row["mean"] is None


def test_more_than_five_values_are_not_ternary(spark):
    rows = spark.createDataFrame([(i * 1e-10, float(i % 3 - 1), float(i % 2) * 7) for i in range(10)], "near double, three double, two double")
    got = {r["feature"]: r["kind"] for r in C.feature_kinds(rows, ["near", "three", "two"]).collect()}
    assert got == {"near": "continuous", "three": "ternary", "two": "binary"}


def test_all_accents_fold(spark):
    df = spark.createDataFrame([("őşžłāñ é é ǖ ế",)], "t string")
    assert df.select(T.fold_accents(F.col("t"))).first()[0] == "oszłan e e u e"


def test_lowest_id_of_each_text(spark):
    rows = spark.createDataFrame([(5, "a", 1.0), (2, "a", 0.0), (9, "b", 1.0), (1, None, 1.0), (0, "b", None)], "id long, text string, y double")
    got = clean_population(rows, "text", "y", "id").collect()
    assert sorted((r["id"], r["text"]) for r in got) == [(2, "a"), (9, "b")]
    plan = clean_population(rows, "text", "y", "id")._jdf.queryExecution().toString()
    assert "SortAggregate" not in plan


def test_labelled_texts_keep_the_lowest_copy(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (4, 1)], "doc_id long, quality int")
    assert [tuple(r) for r in POP.labelled_texts(docs, labels).select("id", "text", "y").collect()] == [(1, "a", 1.0)]


def test_pairs_take_the_first_turns(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "r1"), (1, 2, "user", "x"), (1, 3, "assistant", "r2"), (1, 4, "assistant", "r3"), (2, 0, "user", "q")]
    got = POP.preference_pairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [(r["conv_id"], r["prompt"], r["response_1"], r["response_2"]) for r in got] == [(1, "q", "r1", "r2")]
