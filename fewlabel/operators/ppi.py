"""Prediction-powered means: surrogate average plus a correction from labels."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .moments import Moments

Z95 = 1.96


def ppi_mean(
    rows: DataFrame,
    by: Sequence[str],
    y: str,
    pred: str,
    correction: Column,
    unlabelled: Column,
    labelled: Column | None = None,
    in_target: Column | None = None,
    unit: float = 5.0,
) -> DataFrame:
    """Corrected mean per group from a prediction table, in one pass.

    mean(y - f) over the correction rows plus mean(f) over the unlabelled rows;
    the variance adds both sampling variances (ddof 1). With ``in_target`` the
    finite-population mean is known and coverage is reported. ``unit`` is the
    size of one scaled unit on the raw scale.
    """
    return finish_ppi(rows.groupBy(*by).agg(*ppi_sums(y, pred, correction, unlabelled, labelled, in_target)), unit)


def ppi_sums(
    y: str, pred: str, correction: Column, unlabelled: Column, labelled: Column | None, in_target: Column | None
) -> list[Column]:
    """The conditional sums every PPI number is made from; they add up over batches."""
    label = labelled if labelled is not None else correction
    out = []
    for name, cond, value in (
        ("r", correction, F.col(y) - F.col(pred)),
        ("f", unlabelled, F.col(pred)),
        ("y", label, F.col(y)),
    ):
        v = F.when(cond, value.cast("double"))
        out += [F.count(v).alias(f"n_{name}"), F.sum(v).alias(f"s_{name}"), F.sum(v * v).alias(f"q_{name}")]
    out.append(F.avg(F.when(in_target, F.col(y))).alias("target_mean") if in_target is not None else F.lit(None).cast("double").alias("target_mean"))
    return out


def finish_ppi(sums: DataFrame, unit: float = 5.0) -> DataFrame:
    def mean(k: str) -> Column:
        return F.col(f"s_{k}") / F.col(f"n_{k}")

    def var_samp(k: str) -> Column:
        n = F.col(f"n_{k}")
        centred = F.col(f"q_{k}") - F.col(f"s_{k}") * F.col(f"s_{k}") / n
        return F.when(n > 1, F.greatest(centred, F.lit(0.0)) / (n - 1))

    mu = mean("r") + mean("f")
    ppi_var = var_samp("r") / F.col("n_r") + var_samp("f") / F.col("n_f")
    sample_var = var_samp("y") / F.col("n_y")
    keys = [c for c in sums.columns if c not in {"target_mean", *[f"{a}_{b}" for a in "nsq" for b in "rfy"]}]
    out = sums.select(
        *keys,
        F.col("n_r").alias("correction_size"),
        F.col("n_f").alias("unlabeled_size"),
        mean("r").alias("correction_residual_mean"),
        var_samp("r").alias("correction_residual_var"),
        mean("f").alias("unlabeled_prediction_mean"),
        var_samp("f").alias("unlabeled_prediction_var"),
        mu.alias("mu_hat_ppi"),
        ppi_var.alias("ppi_var_est"),
        (ppi_var * unit * unit).alias("ppi_var_est_raw"),
        F.sqrt(ppi_var).alias("ppi_se"),
        (mu - Z95 * F.sqrt(ppi_var)).alias("ppi_ci_low"),
        (mu + Z95 * F.sqrt(ppi_var)).alias("ppi_ci_high"),
        mean("y").alias("sample_mean"),
        sample_var.alias("sample_mean_var_est"),
        (mean("y") - Z95 * F.sqrt(sample_var)).alias("sample_mean_ci_low"),
        (mean("y") + Z95 * F.sqrt(sample_var)).alias("sample_mean_ci_high"),
        "target_mean",
    )
    t = F.col("target_mean")
    return out.withColumns(
        {
            "error": F.col("mu_hat_ppi") - t,
            "abs_error": F.abs(F.col("mu_hat_ppi") - t),
            "ppi_covered": t.between(F.col("ppi_ci_low"), F.col("ppi_ci_high")),
            "sample_mean_error": F.col("sample_mean") - t,
            "sample_mean_covered": t.between(F.col("sample_mean_ci_low"), F.col("sample_mean_ci_high")),
        }
    )


def sample_mean_estimate(rows: DataFrame, by: Sequence[str], y: str) -> DataFrame:
    out = rows.groupBy(*by).agg(F.count(y).alias("n"), F.avg(y).alias("mean"), (F.var_samp(y) / F.count(y)).alias("var_est"))
    half = F.lit(Z95) * F.sqrt("var_est")
    return out.withColumns({"se": F.sqrt("var_est"), "ci_low": F.col("mean") - half, "ci_high": F.col("mean") + half})


def target_mean(population: DataFrame, ids: DataFrame, id_: str, y: str) -> DataFrame:
    return population.join(ids.select(id_), id_, "left_semi").agg(F.avg(y).alias("target_mean"), F.count(y).alias("n"))


def ppi_plus_plus(rows: DataFrame, by: Sequence[str], y: str, pred: str, labelled: Column, unlabelled: Column) -> DataFrame:
    """Power-tuned mean: the weight on the predictions minimises the variance.

    power = cov(y, f) / ((1 + n/N) var(f)) with the moments of the labelled rows.
    """
    fy, fl, fu = F.when(labelled, F.col(y)), F.when(labelled, F.col(pred)), F.when(unlabelled, F.col(pred))
    s = rows.groupBy(*by).agg(
        F.count(fy).alias("n"),
        F.count(fu).alias("n_unlabeled"),
        F.avg(fy).alias("my"),
        F.avg(fl).alias("mf"),
        F.avg(fu).alias("mu"),
        F.covar_samp(fy, fl).alias("cov"),
        F.var_samp(fl).alias("vf"),
        F.var_samp(fu).alias("vu"),
        F.var_samp(fy).alias("vy"),
    )
    lam = F.when(F.col("vf") > 0, F.try_divide(F.col("cov"), (1 + F.try_divide(F.col("n"), F.col("n_unlabeled"))) * F.col("vf"))).otherwise(F.lit(0.0))
    s = s.withColumn("power", lam)
    lam = F.col("power")
    return s.select(
        *by,
        "n",
        "n_unlabeled",
        "power",
        (F.col("my") + lam * (F.col("mu") - F.col("mf"))).alias("mean"),
        (F.try_divide(F.col("vy") - 2 * lam * F.col("cov") + lam * lam * F.col("vf"), F.col("n")) + F.try_divide(lam * lam * F.col("vu"), F.col("n_unlabeled"))).alias("var_est"),
    )


# --- the same estimate for linear surrogates, from moment matrices only ----------------


@dataclass(frozen=True)
class LinearScore:
    """Mean and variance of y - f and f for f = beta . (1, x), from moments."""

    xs: tuple[str, ...]
    beta: np.ndarray

    def residual(self, m: Moments, y: str) -> tuple[float, float]:
        """Mean and mean square of the residual."""
        b = np.append(-self.beta, 1.0)
        z = ["1", *self.xs, y]
        return float(m.block(["1"], z)[0] @ b / m.n), float(b @ m.block(z, z) @ b / m.n)

    def prediction(self, m: Moments) -> tuple[float, float]:
        z = ["1", *self.xs]
        return float(m.block(["1"], z)[0] @ self.beta / m.n), float(self.beta @ m.block(z, z) @ self.beta / m.n)


def fit_moments(m: Moments, xs: Sequence[str], y: str) -> LinearScore:
    z = ["1", *xs]
    return LinearScore(tuple(xs), np.linalg.pinv(m.block(z, z)) @ m.block(z, [y])[:, 0])


def variance(mean: float, square: float, n: int, ddof: int = 1) -> float | None:
    return max(square - mean * mean, 0.0) * n / (n - ddof) if n > ddof else None


def ppi_from_moments(score: LinearScore, y: str, correction: Moments, unlabelled: Moments, labelled: Moments, target: float | None) -> dict:
    """All PPI and sample-mean numbers of one cell; no row is touched."""
    rm, rq = score.residual(correction, y)
    fm, fq = score.prediction(unlabelled)
    rv, fv = variance(rm, rq, correction.n), variance(fm, fq, unlabelled.n)
    ym = labelled.mean(y)
    yv = variance(ym, float(labelled.block([y], [y])[0, 0]) / labelled.n, labelled.n)
    mu = rm + fm
    pv = None if rv is None or fv is None else rv / correction.n + fv / unlabelled.n
    sv = None if yv is None else yv / labelled.n
    out = {
        "correction_size": correction.n,
        "unlabeled_size": unlabelled.n,
        "correction_residual_var": rv,
        "unlabeled_prediction_var": fv,
        "mu_hat_ppi": mu,
        "ppi_var_est": pv,
        "sample_mean": ym,
        "sample_mean_var_est": sv,
        "target_mean": target,
    }
    for name, centre, v in (("ppi", mu, pv), ("sample_mean", ym, sv)):
        half = None if v is None else Z95 * math.sqrt(v)
        out[f"{name}_ci_low"] = None if half is None else centre - half
        out[f"{name}_ci_high"] = None if half is None else centre + half
        known = half is not None and target is not None
        out[f"{name}_covered"] = (centre - half <= target <= centre + half) if known else None
        out[f"{name}_error"] = None if target is None else centre - target
    return out
