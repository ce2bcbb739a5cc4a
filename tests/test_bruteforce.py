"""Queries without SQL, against plain NumPy on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fewlabel.operators import splits as X
from fewlabel.plans import screening as PL
from fewlabel.plans import surrogates as SU


def ridge(x, y, alpha, w=None):
    w = np.ones(len(y)) if w is None else w
    xm, ym = np.average(x, axis=0, weights=w), np.average(y, weights=w)
    xc, yc = x - xm, y - ym
    b = np.linalg.solve(xc.T @ (xc * w[:, None]) + alpha * np.eye(x.shape[1]), xc.T @ (w * yc))
    return ym - xm @ b, b


def test_embedding_screen(spark):
    rng = np.random.default_rng(8)
    n, d = 240, 4
    e = rng.normal(size=(n, d)).round(3)
    y = e @ np.array([1.0, 0.5, 0.0, -1.0]) + rng.normal(size=n)
    t = rng.normal(size=n) + 0.3 * y
    ev = np.arange(n) >= 160
    rows = [(i, e[i].tolist(), float(y[i]), float(t[i]), "evaluation" if ev[i] else "train_pool") for i in range(n)]
    df = spark.createDataFrame(rows, "id long, v array<double>, y double, t double, screen_split string")
    alphas = [0.1, 10.0, 100.0]
    results, diagnostics = SU.embedding_screen(df, "id", "v", d, "y", {"t": []}, [50], [0, 1], alphas, 5, 20, ridge=0.0)
    got = {(r["method"], r["replication"]): r for r in results.collect()}
    z = np.column_stack([np.ones(n), t])
    h = z[ev].T @ z[ev] / ev.sum()
    a = z @ np.linalg.inv(h)[1]
    beta = np.linalg.lstsq(z[ev], y[ev], rcond=None)[0]
    assert diagnostics.first()["if_var"] == pytest.approx(np.var((a * (y - z @ beta))[ev]))
    assert got[("zero_surrogate", -1)]["ifvar"] == pytest.approx(np.var((a * y)[ev]))
    pool = df.where("screen_split = 'train_pool'").select("id")
    roles = X.train_val_select(pool, "id", [50], [0, 1], 5, 20).where("replication = 1").collect()
    tr = [r["id"] for r in roles if r["role"] == "train"]
    va = [r["id"] for r in roles if r["role"] == "validation"]
    assert len(tr) == 50 and len(va) == 110
    w = a[tr] ** 2 / np.mean(a[tr] ** 2)
    for method, weights, stop in (("ridge_mse_stop_mse", None, "mse"), ("ridge_mse_stop_ifvar", None, "ifvar"), ("ridge_ifweighted_stop_ifvar", w, "ifvar")):
        best = None
        for alpha in alphas:
            b0, b = ridge(e[tr], y[tr], alpha, weights)
            r = y - b0 - e @ b
            score = np.mean(r[va] ** 2) if stop == "mse" else np.var((a * r)[va])
            if best is None or score < best[0]:
                best = (score, alpha, np.var((a * r)[ev]), np.mean(r[ev] ** 2))
        row = got[(method, 1)]
        assert row["alpha"] == best[1]
        assert row["ifvar"] == pytest.approx(best[2]) and row["mse"] == pytest.approx(best[3])


def test_candidate_diagnostics(spark):
    rng = np.random.default_rng(9)
    n = 150
    q, r, s = rng.normal(size=n), rng.normal(size=n), rng.normal(size=n)
    y = q - 0.5 * r + rng.normal(size=n)
    target = np.arange(n) % 3 > 0
    cols = {"delta_q": q, "delta_r": r, "delta_copy": q * 2 + 0.01 * s}
    rows = [(float(y[i]), *[float(c[i]) for c in cols.values()], 0.25, "target" if target[i] else "h_scale") for i in range(n)]
    df = spark.createDataFrame(rows, "y double, " + ", ".join(f"{c} double" for c in cols) + ", pred double, split string")
    df = df.withColumns({f"{c}_raw": F.col(c) for c in cols})
    meta = spark.createDataFrame([("delta_q", "one", "continuous", 0), ("delta_r", "two", "continuous", 1), ("delta_copy", "three", "continuous", 2)], "feature string, family string, kind string, priority int")
    got = {x["feature"]: x for x in PL.candidate_diagnostics(df, meta, list(cols), "y", "pred", [500]).collect()}
    row = got["delta_q"]
    assert row["controls"] == "delta_r" and row["unique_values"] == target.sum() and row["note"] is None
    z = np.column_stack([np.ones(n), q, r])[target]
    yt = y[target]
    h = z.T @ z / target.sum()
    beta = np.linalg.solve(h, z.T @ yt / target.sum())
    a = z @ np.linalg.inv(h)[1]
    assert row["beta_controlled"] == pytest.approx(beta[1])
    assert row["ols_ifvar"] == pytest.approx(np.var(a * (yt - z @ beta)))
    assert row["tfidf_ifvar"] == pytest.approx(np.var(a * (yt - 0.25)))
    assert row["zero_surrogate_ifvar"] == pytest.approx(np.var(a * yt))
    c = np.corrcoef(q[target], r[target])[0, 1]
    assert row["target_vif"] == pytest.approx(1 / (1 - c * c)) and row["max_abs_corr_with_controls"] == pytest.approx(abs(c))
    assert row["if_weight_p99_abs"] == pytest.approx(np.quantile(abs(a), 0.99))
    assert row["direct_ci_halfwidth_B500"] == pytest.approx(1.96 * np.sqrt(row["ols_ifvar"] / 500))


def test_surrogate_scaling(spark, monkeypatch):
    rng = np.random.default_rng(10)
    n, p = 90, 6
    x = rng.normal(size=(n, p))
    y = x[:, 0] - x[:, 1] + rng.normal(size=n)
    a = rng.normal(size=n) + 0.5
    order = rng.permutation(n)
    role = {i: ("train_pool", k + 1) if k < 50 else ("stop", None) if k < 70 else ("scale", None) for k, i in enumerate(order)}
    rows = [(i, 0, role[i][0], role[i][1], float(y[i]), 0.1, [float(a[i])], list(range(p)), x[i].tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, replication long, role string, train_rank long, y double, base double, a array<double>, idx array<int>, val array<double>")
    alphas = [0.1, 1.0, 10.0]
    monkeypatch.setattr(SU, "ROWS_AT_ONCE", 16)  # several chunks
    got = {(r["s"], r["training_objective"]): r for r in SU.surrogate_scaling(df, ["f"], p, [0, 30], alphas).collect()}
    tr, st, sc = order[:30], order[50:70], order[70:]
    base = np.var(a[sc] * (y[sc] - 0.1), ddof=1)
    assert got[(0, "constant")]["ifvar"] == pytest.approx(base)
    w = a[tr] ** 2
    w = np.minimum(w, np.quantile(w, 0.99))
    w = w / w.mean()
    fits = {
        "mse": [ridge(x[tr], y[tr], k) for k in alphas],
        "ifvar_weighted": [ridge(x[tr], y[tr], k, w) for k in alphas],
        "ifvar_exact": [ridge(np.column_stack([a[tr], x[tr] * a[tr][:, None]]), a[tr] * y[tr], k)[1] for k in alphas],
    }
    fits["mse_stop_ifvar"] = fits["mse"]
    for name, models in fits.items():
        scored = []
        for m in models:
            b0, b = (m[0], m[1:]) if name == "ifvar_exact" else m
            res = y - b0 - x @ b
            stop = np.mean(res[st] ** 2) if name == "mse" else np.var(a[st] * res[st], ddof=1)
            scored.append((stop, np.var(a[sc] * res[sc], ddof=1)))
        k = int(np.argmin([v for v, _ in scored]))
        row = got[(30, name)]
        assert row["selected_alpha"] == alphas[k] and row["ifvar"] == pytest.approx(scored[k][1])
        assert row["ifvar_ratio_to_s0"] == pytest.approx(scored[k][1] / base)


def test_wide_moments_emit_one_matrix_per_task_and_group(spark):
    from fewlabel.operators.moments import gram_vectors, unpack

    rng = np.random.default_rng(12)
    dim, n = 300, 120
    z = rng.normal(size=(n, dim))
    rows = [(i % 61 if i % 7 else None, "a" if i % 2 else "b", z[i].tolist(), float(1 + i % 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "g long, h string, z array<double>, w double").coalesce(2)
    seen = []
    got = gram_vectors(df, dim, ["g", "h"])
    for r in got.collect():
        pick = [i for i, x in enumerate(rows) if x[0] == r["g"] and x[1] == r["h"]]
        want = (z[pick] * np.array([rows[i][3] for i in pick])[:, None]).T @ z[pick]
        assert r["n"] == len(pick) and np.allclose(unpack(r["zz"], dim), want)
        seen.append((r["g"], r["h"]))
    assert len(seen) == len(set(seen)) == len({(x[0], x[1]) for x in rows})
