"""Least squares with influence functions, from moment matrices."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .moments import Moments, moments_of
from .quantiles import exact_quantiles, exact_quantiles_of


@dataclass(frozen=True)
class Fit:
    """One regression: coefficients and the inverse-Hessian row of its target."""

    target: str
    xs: tuple[str, ...]
    beta: np.ndarray
    weight_row: np.ndarray
    condition: float
    n: int

    @property
    def beta_target(self) -> float:
        return float(self.beta[1 + self.xs.index(self.target)])


@dataclass(frozen=True)
class RidgeRule:
    """Where a Hessian ridge enters; the data families differ in it."""

    ridge: float = 0.0
    penalize_intercept: bool = True
    ridge_beta: bool = False
    condition_of: str = "raw"


# The four variants by family.
RIDGE_RULES = {
    "single_text": RidgeRule(penalize_intercept=False, ridge_beta=False, condition_of="ridged"),
    "preference": RidgeRule(penalize_intercept=True, ridge_beta=True, condition_of="raw"),
    "preference_scaling": RidgeRule(penalize_intercept=True, ridge_beta=False, condition_of="ridged"),
    "headline_embedding": RidgeRule(penalize_intercept=True, ridge_beta=False, condition_of="raw"),
}


def fit_ols(m: Moments, target: str, xs: Sequence[str], y: str, rule: RidgeRule = RidgeRule()) -> Fit:
    if target not in xs:
        raise ValueError("the target must be one of the regressors")
    cols = ["1", *xs]
    xtx = m.block(cols, cols)
    xty = m.block(cols, [y])[:, 0]
    h = xtx / m.weight
    ridge = np.eye(len(cols)) * rule.ridge
    if not rule.penalize_intercept:
        ridge[0, 0] = 0.0
    ridged = h + ridge
    inverse = np.linalg.pinv(ridged)
    beta = inverse @ (xty / m.weight) if rule.ridge_beta else np.linalg.pinv(xtx) @ xty
    singular = np.linalg.svd(h if rule.condition_of == "raw" else ridged, compute_uv=False)
    condition = float(singular[0] / singular[-1]) if singular[-1] > 0 else math.inf
    return Fit(target, tuple(xs), beta, inverse[1 + list(xs).index(target)], condition, m.n)


def linear(coef: Sequence[float], xs: Sequence[str]) -> Column:
    """coef[0] + sum of coef[j] * x_j, as a plain column expression."""
    out = F.lit(float(coef[0]))
    for c, x in zip(coef[1:], xs):
        out = out + F.lit(float(c)) * F.col(x)
    return out


def if_weight(fit: Fit) -> Column:
    return linear(fit.weight_row, fit.xs)


def predict(fit: Fit) -> Column:
    return linear(fit.beta, fit.xs)


def var(x: Column, ddof: int) -> Column:
    return F.var_samp(x) if ddof == 1 else F.var_pop(x)


def clip_if_weight(a: Column, c: float = 4.0) -> Column:
    return F.greatest(F.lit(-c), F.least(F.lit(c), a))


def if_square_weights(df: DataFrame, a: str, clip: float | None = 0.99, out: str = "w") -> DataFrame:
    """a squared, capped at a quantile, divided by its mean; all ones if degenerate."""
    sq = df.withColumn("__sq", F.col(a) * F.col(a))
    if clip is not None and 0 < clip < 1:
        cap = exact_quantiles(sq, F.col("__sq"), [clip])[0]
        if cap is not None and cap > 0:
            sq = sq.withColumn("__sq", F.least(F.col("__sq"), F.lit(cap)))
    mean = sq.agg(F.avg("__sq").alias("m")).scalar()
    w = F.when(mean > 0, F.col("__sq") / mean).otherwise(F.lit(1.0))
    return sq.withColumn(out, w).drop("__sq")


def ess_share(a: Column) -> Column:
    """(sum a^2)^2 / sum a^4 / n; zero when every weight is zero."""
    fourth = F.sum(F.pow(a, 4))
    return F.when(fourth > 0, F.pow(F.sum(a * a), 2) / fourth / F.count(a)).otherwise(F.lit(0.0))


QUANTILES = (0.5, 0.9, 0.95, 0.99)


def influence_table(df: DataFrame, fits: Mapping[str, Fit], y: str, ddof: int) -> DataFrame:
    """One row per fit, all fits together: IF variance and mean, residual variance,
    absolute-weight quantiles and maximum, effective-sample share.
    """
    # weights and residuals as columns first, so that each is computed once per row
    cols = {}
    for i, fit in enumerate(fits.values()):
        cols[f"__a{i}"] = if_weight(fit)
        cols[f"__r{i}"] = F.col(y) - predict(fit)
    rows = df.select(F.col(y).alias("__y"), *[c.alias(k) for k, c in cols.items()])
    quantiles = exact_quantiles_of(rows, {name: F.abs(F.col(f"__a{i}")) for i, name in enumerate(fits)}, QUANTILES)
    structs = []
    for i, (name, fit) in enumerate(fits.items()):
        a, r, outcome = F.col(f"__a{i}"), F.col(f"__r{i}"), F.col("__y")
        fields = {
            "if_var": var(a * r, ddof),
            "if_mean": F.avg(a * r),
            "residual_var": var(r, ddof),
            "zero_if_var": var(a * outcome, ddof),
            "zero_mse": F.avg(outcome * outcome),
            "if_weight_max": F.max(F.abs(a)),
            "if_ess_share": ess_share(a),
        }
        q = F.array(*[F.lit(v).cast("double") for v in quantiles[name]])
        structs.append(F.struct(F.lit(name).alias("fit"), q.alias("q"), *[c.alias(k) for k, c in fields.items()]))
    wide = rows.agg(F.array(*structs).alias("rows"))
    long = wide.select(F.explode("rows").alias("r")).select("r.*")
    names = {0.5: "p50", 0.9: "p90", 0.95: "p95", 0.99: "p99"}
    return long.select(
        *[c for c in long.columns if c != "q"],
        *[F.col("q")[i].alias(f"if_weight_{names[p]}") for i, p in enumerate(QUANTILES)],
    )


def fit_table(df: DataFrame, fits: Mapping[str, Fit]) -> DataFrame:
    """Coefficients of the fits as a small table (one row per fit)."""
    rows = [
        (k, f.target, ",".join(f.xs), float(f.beta[0]), f.beta_target, f.condition if math.isfinite(f.condition) else None, f.n)
        for k, f in fits.items()
    ]
    return df.sparkSession.createDataFrame(
        rows, "fit string, target string, feature_columns string, intercept double, beta double, hessian_condition double, n long"
    )


def vif(m: Moments, target: str, controls: Sequence[str]) -> float:
    """1 / (1 - R^2) of the target on the controls, with the guards for degenerate cases."""
    if not controls:
        return 1.0
    cols = ["1", *controls]
    beta = np.linalg.pinv(m.block(cols, cols)) @ m.block(cols, [target])[:, 0]
    sst = m.cov(target, target) * m.weight
    if sst <= 0:
        return math.inf
    both = np.append(-beta, 1.0)
    sse = float(both @ m.block([*cols, target], [*cols, target]) @ both)
    r2 = 1.0 - sse / sst
    return math.inf if r2 >= 1 else 1.0 / max(1.0 - r2, 1e-12)


def eligible_controls(
    m: Moments, target: str, controls: Sequence[str], family: Mapping[str, str], limit: float = 0.85
) -> list[str]:
    """Controls of another family whose correlation with the target stays below the limit."""
    out = []
    for c in controls:
        if c == target or c not in m.names:
            continue
        if target in family and family.get(c) == family[target]:
            continue
        r = m.corr(target, c)
        if math.isfinite(r) and abs(r) >= limit:
            continue
        out.append(c)
    return out


def max_abs_corr(m: Moments, target: str, controls: Sequence[str]) -> float:
    found = [abs(m.corr(target, c)) for c in controls]
    return max([f for f in found if math.isfinite(f)], default=0.0)


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long correlation matrix from one moment pass."""
    m = moments_of(df, columns, None)[()]
    rows = []
    for a in columns:
        for b in columns:
            r = m.corr(a, b)
            rows.append((a, b, float(r) if math.isfinite(r) else None))
    return df.sparkSession.createDataFrame(rows, "feature_a string, feature_b string, corr double")


def max_abs_corr_table(df: DataFrame, targets: Sequence[str], controls: Sequence[str]) -> DataFrame:
    names = list(dict.fromkeys([*targets, *controls]))
    m = moments_of(df, names, None)[()]
    rows = [(t, float(max_abs_corr(m, t, [c for c in controls if c != t]))) for t in targets]
    return df.sparkSession.createDataFrame(rows, "feature string, max_abs_corr double")


# --- aggregates on prediction tables -----------------------------------------------


def prediction_metrics(df: DataFrame, by: Sequence[str], y: str = "y_scaled", pred: str = "pred_scaled", unit: float = 5.0) -> DataFrame:
    r = F.col(y) - F.col(pred)
    spread = (F.stddev_pop(y) > 0) & (F.stddev_pop(pred) > 0)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(r).alias("residual_mean_scaled"),
        F.var_samp(r).alias("residual_var_scaled"),
        F.var_samp(r * unit).alias("residual_var_raw"),
        F.sqrt(F.avg(r * r)).alias("rmse_scaled"),
        F.sqrt(F.avg(r * r) * unit * unit).alias("rmse_raw"),
        F.var_samp(pred).alias("prediction_var_scaled"),
        F.when(spread, F.corr(y, pred)).alias("correlation"),
    )


def evaluate_predictions(df: DataFrame, by: Sequence[str], y: str, pred: str, a: str) -> DataFrame:
    r = F.col(y) - F.col(pred)
    return df.groupBy(*by).agg(
        F.avg(r * r).alias("mse"), F.var_pop(F.col(a) * r).alias("ifvar"), F.avg(F.col(a) * r).alias("ifmean")
    )


def residual_loss(kind: str, r: Column, a: Column | None = None) -> Column:
    """var, mse, if_mse or ifvar of a residual column, in population form."""
    forms = {"var": lambda: F.var_pop(r), "mse": lambda: F.avg(r * r)}
    if a is not None:
        forms |= {"if_mse": lambda: F.avg(F.pow(a * r, 2)), "ifvar": lambda: F.var_pop(a * r)}
    if kind not in forms:
        raise ValueError(f"unsupported loss: {kind}")
    return forms[kind]()


def split_counts(df: DataFrame, split: str, y: str) -> DataFrame:
    return df.groupBy(split).agg(
        F.count(F.lit(1)).alias("n"), F.min(y).alias("y_min"), F.max(y).alias("y_max"), F.avg(y).alias("y_mean")
    )


def ci_by_budget(df: DataFrame, ifvar: str, budgets: Sequence[int], unit: float = 1.0) -> DataFrame:
    """1.96 * sqrt(ifvar / B) per budget: half width and length of the interval."""
    rows = df.withColumn("budget", F.explode(F.array(*[F.lit(int(b)).cast("long") for b in budgets])))
    se = F.sqrt(F.greatest(F.col(ifvar), F.lit(0.0)) / F.col("budget"))
    return rows.withColumns(
        {
            "se_proxy": se,
            "ci95_half_width_proxy": F.lit(1.96 * unit) * se,
            "ci95_length_proxy": F.lit(2 * 1.96 * unit) * se,
        }
    )
