"""Conjugate gradients on sparse rows against dense solves."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fewlabel.operators import sparse_ridge as SR

RNG = np.random.default_rng(31)


def dense_ridge(x, y, alpha, w=None):
    w = np.ones(len(y)) if w is None else w
    xm, ym = w @ x / w.sum(), w @ y / w.sum()
    xc, yc = x - xm, y - ym
    b = np.linalg.solve(xc.T @ (w[:, None] * xc) + alpha * np.eye(x.shape[1]), xc.T @ (w * yc))
    return np.append(ym - xm @ b, b)


def sparse_rows(n, p, share):
    x = np.where(RNG.uniform(size=(n, p)) < share, RNG.normal(size=(n, p)), 0.0)
    x[0] = 0.0  # a text without known terms
    return x


def sparse_of(x):
    row, col = np.nonzero(x)
    return SR.Sparse(col, x[row, col], np.bincount(row, minlength=len(x)), x.shape[1])


def test_kernel():
    x = sparse_rows(40, 9, 0.3)
    s, d, u = sparse_of(x), RNG.normal(size=(9, 3)), RNG.normal(size=(40, 2))
    assert np.allclose(s.dot(d), x @ d) and np.allclose(s.tdot(u), x.T @ u)
    ones = s.with_ones()
    assert np.allclose(ones.dot(np.eye(10)), np.column_stack([np.ones(40), x]))
    some = RNG.uniform(size=40) < 0.5
    assert np.allclose(s.taken(some).dot(np.eye(9)), x[some])


@pytest.mark.parametrize("n,p", [(30, 8), (25, 200), (300, 60)])
def test_paths_in_a_task(n, p):
    x, y, a, w = sparse_rows(n, p, 0.2), RNG.normal(size=n) + 3, RNG.normal(size=n), RNG.uniform(0.1, 3, size=n)
    alphas = [0.1, 10.0, 1e4]
    plain, weighted, exact = SR.fit_rows(sparse_of(x), y, alphas), SR.fit_rows(sparse_of(x), y, alphas, w), SR.fit_exact_rows(sparse_of(x), y, a, alphas)
    for k, alpha in enumerate(alphas):
        assert np.allclose(plain[:, k], dense_ridge(x, y, alpha)) and np.allclose(weighted[:, k], dense_ridge(x, y, alpha, w))
        assert np.allclose(exact[:, k], dense_ridge(np.column_stack([a, a[:, None] * x]), a * y, alpha)[1:])


def test_degenerate_rows():
    empty = SR.Sparse(np.zeros(0, np.int64), np.zeros(0), np.zeros(4, np.int64), 3)
    assert SR.fit_rows(empty, np.array([1.0, 2, 3, 4]), [1.0])[:, 0].tolist() == [2.5, 0, 0, 0]
    with pytest.raises(ValueError, match="positive weight"):
        SR.fit_rows(empty, np.ones(4), [1.0], np.zeros(4))
    assert SR.capped_square_weights(np.zeros(5), 0.99).tolist() == [1.0] * 5


def table(spark, x, y, a):
    rows = [(int(i), np.flatnonzero(r).tolist(), r[np.flatnonzero(r)].tolist(), float(t), float(g)) for i, (r, t, g) in enumerate(zip(x, y, a))]
    return spark.createDataFrame(rows, "id long, idx array<int>, val array<double>, y double, a double").repartition(5)


def test_table_equals_dense_at_2000_columns(spark):
    n, p, alphas = 150, 2000, [1.0, 100.0]
    x, y, a = sparse_rows(n, p, 0.01), RNG.normal(size=n), RNG.normal(size=n) + 0.5
    df = table(spark, x, y, a)
    path = SR.sparse_ridge_path(df, "y", p, alphas, gain=F.col("a"), tolerance=1e-11)
    plain = SR.sparse_ridge_path(df, "y", p, alphas, weight=F.col("a") * F.col("a"), tolerance=1e-11)
    for k, alpha in enumerate(alphas):
        assert np.allclose(path[:, k], dense_ridge(np.column_stack([a, a[:, None] * x]), a * y, alpha)[1:], atol=1e-8)
        assert np.allclose(plain[:, k], dense_ridge(x, y, alpha, a * a), atol=1e-8)


def test_table_of_50000_columns(spark):
    n, p = 400, 50_000
    idx = [sorted(RNG.choice(p, 40, replace=False).tolist()) for _ in range(n)]
    y, a = RNG.normal(size=n), RNG.normal(size=n)
    rows = [(i, idx[i], [0.15] * 40, float(y[i]), float(a[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, idx array<int>, val array<double>, y double, a double")
    path = SR.sparse_ridge_path(df, "y", p, [5.0], gain=F.col("a"), tolerance=1e-11)
    assert path.shape == (p + 1, 1)
    # the gradient of the penalised loss vanishes at the solution
    z = SR.Sparse(np.concatenate(idx), np.full(n * 40, 0.15), np.full(n, 40), p).with_ones()
    r = a * y - a * z.dot(path)[:, 0]
    gradient = z.tdot((a * (r - r.mean()))[:, None])[:, 0] - 5.0 * path[:, 0]
    assert np.abs(gradient).max() < 1e-7
    with pytest.raises(ValueError, match="driver"):
        SR.sparse_ridge_path(df, "y", 5_000_000, [5.0])


@pytest.mark.parametrize("numbers", [1, 7, 1 << 18])
@pytest.mark.parametrize("ones", [False, True])
def test_packed_blocks_are_the_rows(monkeypatch, numbers, ones):
    monkeypatch.setattr(SR, "BLOCK_NUMBERS", numbers)
    x = sparse_rows(30, 9, 0.3)
    t, w, g = RNG.normal(size=(3, 30))
    lists = {"idx": [np.flatnonzero(r).tolist() for r in x], "val": [r[np.flatnonzero(r)].tolist() for r in x]}
    batch = pa.RecordBatch.from_pydict({"idx": pa.array(lists["idx"], pa.list_(pa.int32())), "val": pa.array(lists["val"], pa.list_(pa.float64())), "t": t, "w": w, "g": g})
    blocks = list(SR.unpacked(SR.pack([batch], 9, ones), 9 + ones))
    assert numbers == 1 << 18 or all(len(b.t) == 1 or len(b.x.idx) <= numbers for b in blocks)
    want = np.column_stack([np.ones(30), x]) if ones else x
    assert np.allclose(np.vstack([b.x.dot(np.eye(9 + ones)) for b in blocks]), want)
    for c, v in (("t", t), ("w", w), ("g", g)):
        assert np.array_equal(np.concatenate([getattr(b, c) for b in blocks]), v)


def test_steps_read_blocks(spark, monkeypatch):
    """The table that every step reads holds blocks, not a row per text."""
    stored = []
    monkeypatch.setattr(SR, "materialise", lambda df, name, keep=SR.materialise: stored.append(keep(df, name)) or stored[-1])
    x, y, a = sparse_rows(200, 20, 0.2), RNG.normal(size=200), RNG.normal(size=200) + 0.5
    path = SR.sparse_ridge_path(table(spark, x, y, a), "y", 20, [1.0], gain=F.col("a"), tolerance=1e-11)
    assert np.allclose(path[:, 0], dense_ridge(np.column_stack([a, a[:, None] * x]), a * y, 1.0)[1:], atol=1e-8)
    assert [s.count() <= 5 for s in stored] == [True]


@pytest.mark.parametrize("numbers", [SR.DRIVER_NUMBERS, 400])
def test_wide_columns_need_few_steps(spark, monkeypatch, numbers):
    """Correlated wide columns, with which the diagonal alone takes more than 120 steps; all of them, or 20, are in the matrix."""
    monkeypatch.setattr(SR, "DRIVER_NUMBERS", numbers)
    n, p, alphas = 300, 100, [1.0, 50.0]
    x, y, a = sparse_rows(n, p, 0.05), RNG.normal(size=n), RNG.normal(size=n) + 0.5
    x[:, 40:58] += np.cumsum(RNG.normal(size=(n, 18)), axis=1) * np.logspace(0, 2, 18)
    df = table(spark, x, y, a)
    path = SR.sparse_ridge_path(df, "y", p, alphas, gain=F.col("a"), steps=90, tolerance=1e-10)
    plain = SR.sparse_ridge_path(df, "y", p, alphas, weight=F.col("a") * F.col("a"), steps=90, tolerance=1e-10)
    for k, alpha in enumerate(alphas):
        assert np.allclose(path[:, k], dense_ridge(np.column_stack([a, a[:, None] * x]), a * y, alpha)[1:], atol=1e-6)
        assert np.allclose(plain[:, k], dense_ridge(x, y, alpha, a * a), atol=1e-6)


@pytest.mark.parametrize("numbers", [SR.DRIVER_NUMBERS, 48])
def test_nested_training_sets_over_a_table(spark, monkeypatch, numbers):
    """Paths of all training sets equal dense solves, by matrices or by steps, and no function is handed a training set."""
    from pyspark.sql import GroupedData

    from fewlabel.plans import surrogates as SU

    def never(*_):
        raise AssertionError("a training set goes to one task")

    monkeypatch.setattr(GroupedData, "applyInArrow", never)
    monkeypatch.setattr(SR, "DRIVER_NUMBERS", numbers)  # 48 hold neither a matrix of 7 columns nor all paths
    monkeypatch.setattr(SR, "BLOCK_NUMBERS", 40)
    monkeypatch.setattr(SU, "FIT_NUMBERS", 100)
    n, p, alphas = 60, 6, [0.1, 10.0]
    x, y, a = sparse_rows(2 * n, p, 0.3), RNG.normal(size=2 * n), RNG.normal(size=(2 * n, 2)) + 0.5
    rank = np.concatenate([RNG.permutation(n), RNG.permutation(n)]) + 1
    rows = [
        (i // n, "train_pool", int(rank[i]), float(y[i]), a[i].tolist(), np.flatnonzero(x[i]).tolist(), x[i][np.flatnonzero(x[i])].tolist()) for i in range(2 * n)
    ]
    schema = "replication long, role string, train_rank long, y double, a array<double>, idx array<int>, val array<double>"
    df = spark.createDataFrame(rows + [(0, "stop", None, 9.0, [1.0, 1.0], [0], [9.0])], schema).repartition(5)
    got = SU.surrogate_fits(df, ["f", "h"], p, [0, 20, 60], alphas, 0.9, ["plain", "ifvar_weighted", "ifvar_exact"]).collect()
    assert len(got) == 2 * 2 * 5 * 2
    for r in got:
        some = np.flatnonzero((np.arange(2 * n) // n == r["replication"]) & (rank <= r["s"]))
        own = a[some, int(r["feature"] == "h")]
        if r["fit"] == "ifvar_exact":
            want = dense_ridge(np.column_stack([own, own[:, None] * x[some]]), own * y[some], r["alpha"])[1:]
        else:
            want = dense_ridge(x[some], y[some], r["alpha"], SR.capped_square_weights(own, 0.9) if r["fit"] == "ifvar_weighted" else None)
        assert alphas[r["place"]] == r["alpha"] and np.allclose([r["intercept"], *r["coef"]], want, atol=1e-8)
