import numpy as np
import pytest
from pyspark.sql import functions as F

from fewlabel.operators import allocation as A
from fewlabel.operators import ppi as P
from fewlabel.operators import scaling_law as L
from fewlabel.operators.population import affine_scale, affine_unscale

GRID = [0.025, 0.05, 0.075, 0.10, 0.125, 0.15, 0.20, 0.30, 0.40, 0.50, 0.70, 0.90]


def test_corrected_mean_fixture(spark):
    rows = [(2, 82.0, 82.5, "c"), (3, 83.0, 82.5, "c"), (4, None, 85.0, "u"), (5, None, 86.0, "u"), (6, None, 87.0, "u")]
    df = spark.createDataFrame(rows, "id int, y double, f double, role string")
    got = P.ppi_mean(df, [], "y", "f", F.col("role") == "c", F.col("role") == "u").first()
    assert got["mu_hat_ppi"] == pytest.approx(86.0)
    assert got["ppi_var_est"] == pytest.approx(0.5833333333)


def test_label_scale_round_trip(spark):
    df = spark.createDataFrame([(80.0,), (90.0,), (100.0,)], "y double").withColumn("s", affine_scale(F.col("y")))
    assert [r["s"] for r in df.collect()] == [-2.0, 0.0, 2.0]
    assert [r["b"] for r in df.select(affine_unscale(F.col("s")).alias("b")).collect()] == [80.0, 90.0, 100.0]


@pytest.mark.parametrize(
    "params,sizes",
    [
        ((17.401426337966647, 0.573834715845365, 2.8270096710040584), [46, 68, 87, 114]),
        ((16.86, 0.553, 2.754), [46, 68, 88, 116]),
    ],
)
def test_theory_reaches_published_sizes(spark, params, sizes):
    rows = [(b, int(0.8 * b), *params) for b in (300, 500, 700, 1000)]
    df = spark.createDataFrame(rows, "budget long, n_eff long, a double, alpha double, b double")
    got = A.theoretical_allocation(df, GRID).orderBy("budget").collect()
    assert [r["theory_s"] for r in got] == sizes
    assert [round(r["theory_rho"], 3) for r in got] == [round(s / n, 3) for s, n in zip(sizes, (240, 400, 560, 800))]
    if sizes[-1] == 114:
        assert got[0]["theory_eval_rho"] == 0.20 and got[0]["theory_eval_s"] == 48


def curve(spark, s, v, n_eff=8000, bu=2.0, key="m"):
    return spark.createDataFrame([(key, 0, int(a), float(b), n_eff, bu) for a, b in zip(s, v)], "method string, replication long, s long, value double, n_eff long, b_upper double")


def test_power_law_is_recovered(spark):
    s = np.arange(100, 1001, 100)
    fit = L.power_law_fit(curve(spark, s, 3 * s**-0.4 + 0.25), ["method", "replication"]).first()
    assert fit["alpha"] == pytest.approx(0.4, abs=1e-6)
    assert fit["a"] == pytest.approx(3, abs=1e-4) and fit["b"] == pytest.approx(0.25, abs=1e-5)
    assert fit["r2"] > 0.999999


def test_power_law_respects_bounds_and_short_curves(spark):
    s = np.arange(100, 1001, 100)
    rising = L.power_law_fit(curve(spark, s, np.linspace(1, 2, 10), bu=1.2), ["method", "replication"]).first()
    assert rising["a"] >= 0 and 0 <= rising["b"] <= 1.2 and 0.02 <= rising["alpha"] <= 1.5
    short = L.power_law_fit(curve(spark, s[:2], [2.0, 1.0]), ["method", "replication"]).first()
    assert short["a"] is None and short["n_points"] == 2


def test_rampup_fixture(spark):
    v = [8, 5, 3, 2.2, 2, 2.1, 2.3, 2.6, 3, 3.6]
    c = curve(spark, range(100, 1001, 100), v, bu=10.0)
    row = L.rampup_replay(c, ["method", "replication"]).first()
    assert (row["oracle_s"], row["stopped_stage"], row["ramp_s"]) == (500, 10, 900)
    assert row["regret"] == pytest.approx(0.5845, abs=1e-4)
    largest = L.rampup_replay(c, ["method", "replication"], pick="largest").first()
    assert largest["ramp_s"] == 1000


def test_published_savings(spark):
    rows, stops = [], []
    for b, used in ((300, 8), (500, 8), (700, 6), (1000, 5)):
        n = int(0.8 * b)
        sizes = [round(r * n) for r in GRID]
        rows += [(b, s) for s in sizes]
        stops.append((b, sizes[used - 1]))
    c = spark.createDataFrame(rows, "budget long, s long")
    st = spark.createDataFrame(stops, "budget long, stopped_largest_s long")
    got = L.rampup_savings(c, st, ["budget"]).orderBy("budget").collect()
    assert [round(100 * r["fit_count_saving"], 1) for r in got] == [33.3, 33.3, 50.0, 58.3]
    assert [round(100 * r["label_effort_saving"], 1) for r in got] == [70.9, 70.9, 85.1, 89.4]


def test_fitted_optimum_between_integers(spark):
    fits = spark.createDataFrame([(17.4, 0.57, 2.83, 400)], "a double, alpha double, b double, n_eff long")
    whole = L.fitted_optimum(fits, []).first()["fitted_s_star"]
    fine = L.fitted_optimum(fits, [], refine=True).first()["fitted_s_star"]
    assert abs(whole - fine) <= 1 and fine != whole


def test_t_quantile(spark):
    row = spark.range(1).select(L.t_quantile(F.lit(9)).alias("a"), L.t_quantile(F.lit(60)).alias("b")).first()
    assert row["a"] == pytest.approx(2.262157, abs=1e-6) and row["b"] == pytest.approx(2.000298, abs=1e-5)


def test_trim_drops_both_ends(spark):
    df = spark.createDataFrame([("m", r, float(v)) for r, v in enumerate([5, 1, 3, 9, 4])], "method string, replication long, v double")
    assert sorted(r["v"] for r in L.trim_replications(df, ["method"], "v").collect()) == [3.0, 4.0, 5.0]


def test_moment_cells_equal_row_by_row(spark):
    from fewlabel.operators import splits as X
    from fewlabel.plans.allocation import ppi_cells

    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 2))
    y = 2 + x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=900)
    pop = spark.createDataFrame([(i, float(a), float(b), float(v)) for i, ((a, b), v) in enumerate(zip(x, y))], "id long, x1 double, x2 double, y double")
    members = X.allocation_split(pop, "id", [0, 1], [100], seed=1)
    cell = ppi_cells(pop, members, {"m": ["x1", "x2"]}, "y", "id", [0.25, 0.5]).where("replication = 1 AND s_train = 20").first()
    mine = {r["id"]: r["train_rank"] for r in members.where("replication = 1").collect()}
    tr = [i for i, k in mine.items() if k is not None and k <= 20]
    co = [i for i, k in mine.items() if k is not None and k > 20]
    un = [i for i in range(900) if i not in mine]
    z = np.column_stack([np.ones(900), x])
    beta = np.linalg.lstsq(z[tr], y[tr], rcond=None)[0]
    f = z @ beta
    assert cell["mu_hat_ppi"] == pytest.approx((y - f)[co].mean() + f[un].mean())
    assert cell["ppi_var_est"] == pytest.approx((y - f)[co].var(ddof=1) / len(co) + f[un].var(ddof=1) / len(un))
    va = [i for i, k in mine.items() if k is None]
    assert cell["validation_corr"] == pytest.approx(np.corrcoef(y[va], f[va])[0, 1])


def test_cross_fitted_mean_covers(spark):
    from fewlabel.plans.crossfit import crossppi_mean

    rng = np.random.default_rng(3)
    hits = 0
    for k in range(12):
        x = rng.normal(size=600)
        y = 1 + 2 * x + rng.normal(size=600)
        rows = [(i, float(x[i]), float(y[i]) if i < 150 else None) for i in range(600)]
        got = crossppi_mean(spark.createDataFrame(rows, "id long, x double, y double"), ["x"], "y", "id", 5, k).first()
        hits += abs(got["mu_hat"] - 1) <= 1.96 * np.sqrt(got["var_est"])
    assert hits >= 10


def test_checkpoint_rule(spark):
    from fewlabel.operators.checkpoints import select_checkpoint

    v = [5.0, 4.0, 3.95, 3.0, 3.1, 3.2, 3.3, 1.0]
    df = spark.createDataFrame([("c", i + 1, x) for i, x in enumerate(v)], "cell string, epoch long, metric double")
    row = select_checkpoint(df, ["cell"], "epoch", "metric", patience=3).first()
    assert (row["epochs_trained"], row["early_stopped"], row["best_epoch"]) == (7, True, 4)
    strict = select_checkpoint(df, ["cell"], "epoch", "metric", min_delta=0.1, patience=2, min_epochs=4).first()
    assert strict["best_epoch"] == 4
    full = select_checkpoint(df, ["cell"], "epoch", "metric", patience=9).first()
    assert (full["early_stopped"], full["best_epoch"]) == (False, 8)


def _checkpoints(spark, folder, rows):
    """The query's and its SQL's rows over events (event_id, ts, user_id, value), stored in the order given."""
    import duckdb

    from fewlabel.queries import ORACLES, QUERIES

    folder.mkdir()
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, value DOUBLE)")
    con.executemany("INSERT INTO events VALUES (?, ?, ?, ?)", rows)
    con.execute(f"COPY events TO '{folder}/events.parquet' (FORMAT parquet)")
    got = QUERIES["select_checkpoint"](spark, str(folder)).collect()
    return sorted(map(tuple, got), key=str), sorted(con.execute(ORACLES["select_checkpoint"]).fetchall(), key=str)


def test_checkpoints_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    rows = [(1, "2024-01-01 01:00:00", 1, 0.1), (2, "2024-01-01 02:00:00", 1, 0.2), (3, "2024-01-01 03:00:00", 1, 0.3), (4, "2024-01-02 01:00:00", 1, 0.2)]
    assert (0.1 + 0.2 + 0.3) / 3 > 0.2 and (0.3 + 0.2 + 0.1) / 3 <= 0.2
    there, _ = _checkpoints(spark, tmp_path / "there", rows)
    back, _ = _checkpoints(spark, tmp_path / "back", rows[::-1])
    assert there == back == [(1, 2, False, 2, 0.2)]


def test_checkpoints_of_events_with_nulls_equal_sql(spark, tmp_path):
    rows = [(1, "2024-01-01 01:00:00", None, 1.0), (2, "2024-01-02 01:00:00", None, 2.0)]  # no user
    rows += [(3, None, 1, 5.0), (4, "2024-01-01 01:00:00", 1, 7.0), (5, "2024-01-02 01:00:00", 1, 9.0)]  # a day of null is the last
    rows += [(6, "2024-01-01 01:00:00", 2, None), (7, "2024-01-02 01:00:00", 2, None)]  # no metric at all
    rows += [(8, "2024-01-01 01:00:00", 3, None), (9, "2024-01-02 01:00:00", 3, 2.0), (10, "2024-01-03 01:00:00", 3, None)]
    got, want = _checkpoints(spark, tmp_path / "nulls", rows)
    assert got == want and len(got) == 3


def test_wide_bounds_without_a_cap_on_b(spark):
    s = np.arange(100, 1001, 100)
    fit = L.power_law_fit(curve(spark, s, 40000 * s**-2.2 + 7.5), ["method", "replication"], b_upper=None, alpha_bounds=L.WIDE_ALPHA_BOUNDS).first()
    assert fit["alpha"] == pytest.approx(2.2, abs=1e-4) and fit["b"] == pytest.approx(7.5, abs=1e-5)


def test_bootstrap_draws_are_whole_and_repeatable(spark):
    df = spark.createDataFrame([("m", r, float(r)) for r in range(4)], "method string, replication long, v double")
    a = A.bootstrap(df, ["method"], "replication", range(4), 30, seed=5)
    sizes = {r["count"] for r in a.groupBy("draw").count().collect()}
    assert sizes == {4}
    again = A.bootstrap(df, ["method"], "replication", range(4), 30, seed=5)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, again.collect()))


def test_percentiles_of_many_values_rank_few(spark, monkeypatch):
    from fewlabel.operators import quantiles as Q

    n, probs = 1_000_000, [0.0, 0.001, 0.25, 0.5, 0.99, 1.0]
    df = spark.range(n).select(
        F.exp((F.col("id") * 7919 % n) / 50_000.0).alias("x"),
        F.when(F.col("id") % 3 > 0, F.lit(5.0)).otherwise(F.col("id").cast("double")).alias("y"),
    )
    bounds, ranked = [], Q._ranked

    def watched(wide, ranges, at):
        inside = [wide.where(F.col(f"__{k[0]}").between(*map(F.lit, r))).select(f"__{k[0]}").distinct().count() for k, r in ranges.items()]
        bounds.extend(inside)
        return ranked(wide, ranges, at)

    monkeypatch.setattr(Q, "_ranked", watched)
    got = Q.exact_quantiles_of(df, {"x": F.col("x"), "y": F.col("y")}, probs, most=50)
    ids = np.arange(n)
    assert np.allclose(got["x"], np.quantile(np.exp(ids * 7919 % n / 50_000.0), probs), rtol=1e-12)
    assert got["y"] == np.quantile(np.where(ids % 3 > 0, 5.0, ids), probs).tolist()
    assert len(bounds) >= 6 and max(bounds) <= 50
    few = spark.createDataFrame([(1.0,), (None,), (3.0,)], "x double")
    assert Q.exact_quantiles_of(few, {"x": F.col("x"), "z": F.lit(None)}, [0.0, 0.5, 1.0], most=1) == {"x": [1.0, 2.0, 3.0], "z": [None] * 3}
