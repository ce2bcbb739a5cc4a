"""Cross-fitted corrected means: every label corrects, none corrects itself."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.moments import Moments, moments_of
from ..operators.ppi import LinearScore, fit_moments, variance
from ..operators.splits import kfold


def _fold_sums(population: DataFrame, xs: Sequence[str], y: str, id_: str, folds: int, seed: int) -> tuple[dict[int, Moments], Moments, Moments]:
    """Sums of each fold of the labelled rows, of all of them and of the unlabelled pool; one scan each."""
    labelled = population.where(F.col(y).isNotNull()).withColumn("fold", kfold(F.col(id_), folds, seed))
    parts = {k[0]: m for k, m in moments_of(labelled, xs, y, ["fold"]).items()}
    if len(parts) < 2:
        raise ValueError("cross-fitting needs labels in two folds at least")
    total: Moments | None = None
    for m in parts.values():
        total = m if total is None else total + m
    pool = moments_of(population.where(F.col(y).isNull()), xs, None).get(())
    if pool is None or not pool.n:
        raise ValueError("cross-fitting needs unlabelled rows")
    return parts, total, pool


def _corrected(parts: dict[int, Moments], pool: Moments, scores: dict[int, LinearScore], y: str) -> tuple[float, float]:
    """Corrected mean and its variance: out-of-fold residuals plus the mean predictor on the pool."""
    n = sum(m.n for m in parts.values())
    means = [(parts[k].n, *scores[k].residual(parts[k], y)) for k in parts]
    mean = sum(c * m for c, m, _ in means) / n
    square = sum(c * q for c, _, q in means) / n
    average = LinearScore(next(iter(scores.values())).xs, np.mean([s.beta for s in scores.values()], axis=0))
    fm, fq = average.prediction(pool)
    return mean + fm, variance(mean, square, n) / n + variance(fm, fq, pool.n) / pool.n


def crossppi_mean(population: DataFrame, xs: Sequence[str], y: str, id_: str, folds: int, seed: int) -> DataFrame:
    """K fits from (total - fold) moments; the unlabelled pool gets the mean predictor."""
    parts, total, pool = _fold_sums(population, xs, y, id_, folds, seed)
    scores = {k: fit_moments(total - m, xs, y) for k, m in parts.items()}
    mean, var = _corrected(parts, pool, scores, y)
    return population.sparkSession.createDataFrame(
        [(total.n, pool.n, mean, var)], "n_labelled long, n_unlabeled long, mu_hat double, var_est double"
    )


def reppi_mean(population: DataFrame, pred: str, xs: Sequence[str], y: str, id_: str, folds: int, seed: int) -> DataFrame:
    """Recalibrated PPI: a given prediction is refitted to the labels before it is used.

    Per fold, y is regressed on (prediction, features) over the other folds,
    whose sums are the total less the fold's, and the recalibrated prediction
    enters with the power N / (n + N) that is best for one that has been
    calibrated. A prediction that is biased, scaled or useless thus costs no
    precision against the labels alone. ``power`` and the sample mean are
    returned beside the estimate. Fewer than two folds with labels, or no
    unlabelled row, stop the job.
    """
    columns = [pred, *xs]
    parts, total, pool = _fold_sums(population, columns, y, id_, folds, seed)
    power = pool.n / (total.n + pool.n)
    scores = {k: LinearScore(tuple(columns), power * fit_moments(total - m, columns, y).beta) for k, m in parts.items()}
    mean, var = _corrected(parts, pool, scores, y)
    plain = total.mean(y)
    spread = variance(plain, float(total.block([y], [y])[0, 0]) / total.n, total.n) / total.n
    return population.sparkSession.createDataFrame(
        [(total.n, pool.n, power, mean, var, plain, spread)],
        "n_labelled long, n_unlabeled long, power double, mu_hat double, var_est double, sample_mean double, sample_var_est double",
    )
