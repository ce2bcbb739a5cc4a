import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fewlabel.operators import influence as I
from fewlabel.operators import moments as G
from fewlabel.operators import surrogate as U
from fewlabel.operators.quantiles import exact_quantiles_of
from fewlabel.operators.scaling import scale_no_center, zscore

RNG = np.random.default_rng(4)


@pytest.fixture(scope="module")
def table(spark):
    x = RNG.normal(size=(400, 5))
    y = 1.5 + x @ np.array([1.0, -2.0, 0.5, 0.0, 3.0]) + RNG.normal(size=400)
    df = spark.createDataFrame(
        [(i, i % 3, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))],
        "id int, g int, " + ", ".join(f"x{j} double" for j in range(5)) + ", y double",
    ).cache()
    return df, x, y


def test_ols_matches_numpy(table):
    df, x, y = table
    names = [f"x{j}" for j in range(5)]
    fit = I.fit_ols(G.moments_of(df, names, "y")[()], "x2", names, "y")
    z = np.column_stack([np.ones(400), x])
    beta = np.linalg.lstsq(z, y, rcond=None)[0]
    a = z @ np.linalg.inv(z.T @ z / 400)[3]
    r = y - z @ beta
    row = I.influence_table(df, {"f": fit}, "y", 1).first()
    assert np.allclose(fit.beta, beta)
    assert math.isclose(fit.condition, np.linalg.cond(z.T @ z / 400), rel_tol=1e-9)
    assert math.isclose(row["if_var"], np.var(a * r, ddof=1), rel_tol=1e-9)
    assert math.isclose(row["if_weight_p95"], np.quantile(abs(a), 0.95), rel_tol=1e-9)
    assert math.isclose(row["if_ess_share"], (a**2).sum() ** 2 / (a**4).sum() / 400, rel_tol=1e-9)


def test_moments_do_not_depend_on_partitions(table):
    df, *_ = table
    names = ["x0", "x1"]
    one = G.moments_of(df.coalesce(1), names, "y", ["g"])
    many = G.moments_of(df.repartition(7), names, "y", ["g"])
    assert all(np.allclose(one[k].m, many[k].m) for k in one)


def test_vector_moments_equal_column_moments(table):
    df, *_ = table
    names = [f"x{j}" for j in range(5)]
    z = df.select("g", F.array(F.lit(1.0), *names, "y").alias("z"), F.lit(1.0).alias("w"))
    got = G.collect_moments(G.gram_vectors(z, 7, ["g"]), ["1", *names, "y"], ["g"])
    want = G.moments_of(df, names, "y", ["g"])
    assert all(np.allclose(got[k].m, want[k].m) and got[k].n == want[k].n for k in want)


def test_sparse_moments_equal_dense(spark, table):
    df, *_ = table
    sparse = df.select(F.array(F.lit(0), F.lit(1)).alias("idx"), F.array("x0", "x1").alias("val"), "y", F.lit(2.0).alias("w"))
    got = G.collect_moments(G.gram_vectors(sparse, 4), ["1", "x0", "x1", "y"])[()]
    want = G.moments_of(df, ["x0", "x1"], "y", weight=F.lit(2.0))[()]
    assert np.allclose(got.m, want.m)


def test_vif_and_controls(table):
    df, x, _ = table
    wide = df.withColumn("x5", F.col("x0") * 2 + F.col("x1") * 0.01)
    m = G.moments_of(wide, ["x0", "x1", "x5"], "y")[()]
    assert I.vif(m, "x0", []) == 1.0
    assert I.vif(m, "x0", ["x1"]) == pytest.approx(1 / (1 - np.corrcoef(x[:, 0], x[:, 1])[0, 1] ** 2))
    assert I.eligible_controls(m, "x0", ["x0", "x1", "x5"], {}) == ["x1"]
    assert I.eligible_controls(m, "x0", ["x1"], {"x0": "f", "x1": "f"}) == []


@pytest.mark.parametrize("family", list(I.RIDGE_RULES))
def test_ridge_rules(table, family):
    from dataclasses import replace

    df, x, y = table
    rule = replace(I.RIDGE_RULES[family], ridge=0.1)
    fit = I.fit_ols(G.moments_of(df, ["x0", "x1"], "y")[()], "x0", ["x0", "x1"], "y", rule)
    z = np.column_stack([np.ones(400), x[:, :2]])
    h = z.T @ z / 400
    ridge = 0.1 * np.eye(3)
    if family == "single_text":
        ridge[0, 0] = 0
    inverse = np.linalg.inv(h + ridge)
    beta = inverse @ (z.T @ y / 400) if family == "preference" else np.linalg.solve(h, z.T @ y / 400)
    assert np.allclose(fit.beta, beta) and np.allclose(fit.weight_row, inverse[1])


@pytest.mark.parametrize("margin", [3e-4, 1e-9, 1.0])
def test_quantiles_are_exact(spark, margin):
    columns = {
        "mixed": np.concatenate([np.full(4000, 2.0), RNG.exponential(size=8000), RNG.normal(size=500) * 1e6]),
        "capped": np.concatenate([np.linspace(0, 1, 30), np.full(12_470, 1.0)]),
        "few": RNG.integers(0, 3, 12_500).astype(float),
    }
    rows = [tuple(map(float, r)) + (None,) for r in zip(*columns.values())]
    df = spark.createDataFrame(rows, "mixed double, capped double, few double, none double").repartition(3)
    probs = [0.0, 0.001, 0.25, 0.5, 0.77, 0.99, 1.0]
    got = exact_quantiles_of(df, {c: F.col(c) for c in df.columns}, probs, margin=margin)
    for name, values in columns.items():
        assert np.allclose(got[name], np.quantile(values, probs), rtol=1e-12)
    assert got["none"] == [None] * len(probs)


def test_square_weights(spark):
    df = spark.createDataFrame([(float(v),) for v in (-2, -1, 0, 1, 5)], "a double")
    w = [r["w"] for r in I.if_square_weights(df, "a", 0.8).collect()]
    assert np.mean(w) == pytest.approx(1) and min(w) >= 0
    ones = I.if_square_weights(spark.createDataFrame([(0.0,), (0.0,)], "a double"), "a", 0.8).collect()
    assert [r["w"] for r in ones] == [1.0, 1.0]


def test_ess_share(spark):
    even = spark.createDataFrame([(1.0,)] * 10, "a double").agg(I.ess_share(F.col("a")).alias("e")).first()["e"]
    peak = spark.createDataFrame([(10.0,)] + [(0.1,)] * 9, "a double").agg(I.ess_share(F.col("a")).alias("e")).first()["e"]
    assert even == pytest.approx(1.0) and peak < 0.2


def test_losses(spark):
    row = spark.createDataFrame([(v,) for v in (1.0, 2.0, 4.0, 5.0)], "r double").agg(
        I.residual_loss("var", F.col("r")).alias("v"), I.residual_loss("mse", F.col("r")).alias("m")
    ).first()
    assert (row["v"], row["m"]) == (2.5, 11.5)
    with pytest.raises(ValueError):
        I.residual_loss("huber", F.col("r"))


def test_scaling_keeps_signs_and_flattens_constants(spark):
    df = spark.createDataFrame([(float(v), 7.0) for v in (-2, -1, 0, 1, 2)], "x double, c double")
    got = [r["s"] for r in scale_no_center(df, {"s": "x"}).orderBy("x").collect()]
    assert np.allclose(got, -np.array(got[::-1])) and np.mean(got) == pytest.approx(0)
    assert {r["z"] for r in zscore(df, {"z": "c"}).collect()} == {0.0}
    with pytest.raises(Exception, match="zero spread"):
        scale_no_center(df, {"s": "c"}, zero_sd="raise").collect()


def test_ridge_from_moments_matches_normal_equations(table):
    df, x, y = table
    m = G.moments_of(df, ["x0", "x1", "x2"], "y")[()]
    beta = U.ridge_from_moments(m, ["x0", "x1", "x2"], "y", 5.0)
    xc, yc = x[:, :3] - x[:, :3].mean(0), y - y.mean()
    b = np.linalg.solve(xc.T @ xc + 5 * np.eye(3), xc.T @ yc)
    assert np.allclose(beta[1:], b) and beta[0] == pytest.approx(y.mean() - x[:, :3].mean(0) @ b)


def test_ifvar_from_moments_equals_direct(table):
    df, x, y = table
    a = x[:, 4] + 0.5
    rows = df.withColumn("a", F.col("x4") + 0.5)
    sq = G.moments_of(rows, ["x0"], "y", weight=F.col("a") * F.col("a"))[()]
    fi = G.moments_of(rows, ["x0"], "y", weight=F.col("a"))[()]
    beta = np.array([0.3, -1.1])
    assert U.ifvar_of(beta, sq, fi, ["x0"], "y", 1) == pytest.approx(np.var(a * (y - 0.3 + 1.1 * x[:, 0]), ddof=1))


def test_exact_ifvar_ridge_minimises_the_variance(table):
    df, x, y = table
    a = x[:, 4] + 0.5
    aug = U.augmented(df.withColumn("a", F.col("x4") + 0.5), "a", ["x0"], "y")
    theta = U.ridge_ifvar_exact(G.moments_of(aug, ["a", "a_x0"], "a_y")[()], ["x0"], 1e-9)

    def loss(t):
        return np.var(a * (y - t[0] - t[1] * x[:, 0]))

    best = loss(theta)
    for d in ([0.01, 0], [-0.01, 0], [0, 0.01], [0, -0.01]):
        assert loss(theta + np.array(d)) > best


def test_batch_score_scores_each_text_once(spark):
    df = spark.createDataFrame([(1, "aa"), (2, "b"), (3, "aa"), (4, None)], "id int, t string")
    out = {r["id"]: r["score"] for r in U.batch_score(df, "t", lambda s: s.str.len() * 1.0, batch=1).collect()}
    assert out == {1: 2.0, 2: 1.0, 3: 2.0, 4: None}


def test_batch_score_goes_on_from_its_store(spark, tmp_path):
    store = str(tmp_path / "scores")
    df = spark.createDataFrame([(1, "aa"), (2, "b"), (3, "aa"), (4, None)], "id int, t string").coalesce(1)
    scored = U.batch_score(df, "t", lambda s: s.str.len() * 1.0, store=store)
    assert spark.read.parquet(store).count() == 2
    assert "SortAggregate" not in scored._jdf.queryExecution().toString()

    def fails(texts):
        assert not len(texts), "a known text was scored again"
        return texts

    again = {r["id"]: r["score"] for r in U.batch_score(df, "t", fails, store=store).collect()}
    assert again == {1: 2.0, 2: 1.0, 3: 2.0, 4: None}
    more = df.unionByName(spark.createDataFrame([(5, "ccc")], "id int, t string"))
    assert U.batch_score(more, "t", lambda s: s.str.len() * 10.0, store=store).where("id in (1, 5)").agg(F.sum("score")).first()[0] == 32.0
    assert spark.read.parquet(store).count() == 3


def test_recalibration_repairs_a_bad_prediction(spark):
    from fewlabel.plans.crossfit import reppi_mean

    n = 1500
    x = RNG.normal(size=n)
    y = 2 + 3 * x + 0.3 * RNG.normal(size=n)
    rows = [(i, float(y[i]) if i % 5 == 0 else None, float(100 - 7 * x[i]), float(RNG.normal())) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, y double, f double, z double")
    got = reppi_mean(df, "f", ["z"], "y", "id", folds=3, seed=4).first()
    lab = np.array([r[1] is not None for r in rows])
    assert got["n_labelled"] == lab.sum() and got["power"] == pytest.approx(0.8)
    assert got["sample_mean"] == pytest.approx(y[lab].mean()) and got["sample_var_est"] == pytest.approx(y[lab].var(ddof=1) / lab.sum())
    assert got["var_est"] < 0.35 * got["sample_var_est"] and abs(got["mu_hat"] - y.mean()) < 4 * got["var_est"] ** 0.5
    with pytest.raises(ValueError, match="unlabelled"):
        reppi_mean(df.where("y is not null"), "f", [], "y", "id", 3, 4)
