"""Grids of linear surrogates: scaling curves and corrected means per cell.

The rows are read three times at most (draw, labelled rows, population totals);
every cell of the grid is then algebra on small matrices.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.moments import Moments, moments_of
from ..operators.ppi import fit_moments, ppi_from_moments, variance
from ..operators.splits import s_for_rho

CELL_SCHEMA = (
    "method string, budget long, replication long, rho double, allocation_source string, validation_size long, "
    "n_eff long, s_train long, correction_size long, unlabeled_size long, correction_residual_var double, "
    "unlabeled_prediction_var double, mu_hat_ppi double, ppi_var_est double, ppi_ci_low double, ppi_ci_high double, "
    "ppi_covered boolean, ppi_error double, sample_mean double, sample_mean_var_est double, sample_mean_ci_low double, "
    "sample_mean_ci_high double, sample_mean_covered boolean, sample_mean_error double, target_mean double, "
    "validation_residual_var double, validation_rmse double, validation_corr double"
)
CURVE_SCHEMA = (
    "method string, replication long, s long, n_eff long, population_var double, scale_residual_var double, "
    "scale_residual_mean double, scale_rmse double, scale_corr double, stop_residual_var double, stop_mse double"
)


def _sum(parts: Sequence[Moments]) -> Moments | None:
    out = None
    for p in parts:
        out = p if out is None else out + p
    return out


def _banded(members: DataFrame, population: DataFrame, id_: str, cuts: Mapping[int, Sequence[int]], key: str | None, keys: Sequence[str]):
    """Members with their features and the number of training cuts below their rank.

    Members drawn from rows that carry the features need no join.
    """
    carried = set(population.columns) <= set(members.columns)
    rows = members if carried else members.select(id_, "train_rank", *keys).join(population, id_)
    band = F.lit(None).cast("int")
    for value, grid in cuts.items():
        code = F.size(F.filter(F.array(*[F.lit(int(s)) for s in grid]), lambda s: s < F.col("train_rank")))
        band = F.when(F.col(key) == value, code).otherwise(band) if key else code
    return rows.withColumn("band", F.when(F.col("train_rank").isNull(), F.lit(-1)).otherwise(band))


def ppi_cells(
    population: DataFrame,
    members: DataFrame,
    methods: Mapping[str, Sequence[str]],
    y: str,
    id_: str,
    rhos: Sequence[float],
    exact: Mapping[tuple[str, int], float] | None = None,
    target_known: bool = True,
    sizes: Mapping[int, int] | None = None,
) -> DataFrame:
    """One row per (method, budget, replication, rho), grid and theory-exact cells.

    ``members`` is an allocation split of ``population``; ``exact`` adds, per
    (method, budget), a rho outside the grid; ``sizes`` says the validation size
    of each budget where it is known, so that the draw is made only once.
    """
    xs = sorted({x for cols in methods.values() for x in cols})
    narrow = population.select(id_, y, *xs)
    if sizes is None:
        found = members.select("budget", "validation_size").distinct().collect()
        sizes = {int(r["budget"]): int(r["validation_size"]) for r in found}
    budgets = {b: (v, b - v) for b, v in sizes.items()}
    plans: dict[int, list[tuple[str | None, str, float, int]]] = {}
    for b, (_, n_eff) in budgets.items():
        cells = [(None, "grid", rho, s_for_rho(rho, n_eff)) for rho in rhos]
        for (method, budget), rho in (exact or {}).items():
            if budget == b and all(abs(rho - g) > 1e-10 for g in rhos):
                cells.append((method, "theory_exact", rho, s_for_rho(rho, n_eff)))
        plans[b] = cells
    cuts = {b: sorted({s for *_, s in cells}) for b, cells in plans.items()}
    rows = _banded(members, narrow, id_, cuts, "budget", ["budget", "replication"])
    bands = moments_of(rows, xs, y, ["budget", "replication", "band"])
    totals = moments_of(narrow, xs, y if target_known else None)[()]
    target = totals.mean(y) if target_known else None
    out = []
    for (b, rep) in sorted({k[:2] for k in bands}):
        by_band = {k[2]: m for k, m in bands.items() if k[:2] == (b, rep)}
        labelled = _sum(list(by_band.values()))
        validation = by_band.get(-1)
        grid = cuts[b]
        unlabelled = _without(totals, labelled)
        for only, source, rho, s in plans[b]:
            place = bisect.bisect_left(grid, s)
            train = _sum([m for k, m in by_band.items() if 0 <= k <= place])
            correction = _sum([m for k, m in by_band.items() if k > place])
            for method, cols in methods.items():
                if only is not None and only != method:
                    continue
                score = fit_moments(train, cols, y)
                cell = ppi_from_moments(score, y, correction, unlabelled, labelled, target)
                mean, square = score.residual(validation, y)
                cell |= {
                    "method": method,
                    "budget": b,
                    "replication": rep,
                    "rho": float(rho),
                    "allocation_source": source,
                    "validation_size": budgets[b][0],
                    "n_eff": budgets[b][1],
                    "s_train": s,
                    "validation_residual_var": variance(mean, square, validation.n),
                    "validation_rmse": math.sqrt(square),
                    "validation_corr": _corr(score, validation, y),
                }
                out.append(cell)
    names = [f.strip().split(" ")[0] for f in CELL_SCHEMA.split(",")]
    return population.sparkSession.createDataFrame([tuple(c[n] for n in names) for c in out], CELL_SCHEMA)


def _without(totals: Moments, labelled: Moments) -> Moments:
    """Moments of the unlabelled rows: everything less the labelled, on shared columns."""
    keep = list(totals.names)
    part = Moments(totals.names, labelled.n, labelled.block(keep, keep))
    return totals - part


def _corr(score, m: Moments, y: str) -> float | None:
    fm, fq = score.prediction(m)
    rm, rq = score.residual(m, y)
    vy, vf, vr = m.cov(y, y), fq - fm * fm, rq - rm * rm
    if vy <= 0 or vf <= 1e-15 * max(fq, 1e-300):
        return None
    return (vy + vf - vr) / 2 / math.sqrt(vy * vf)


def scaling_curve(
    population: DataFrame, members: DataFrame, methods: Mapping[str, Sequence[str]], y: str, id_: str, s_grid: Sequence[int]
) -> DataFrame:
    """Residual variance of every nested training size, per method and replication."""
    xs = sorted({x for cols in methods.values() for x in cols})
    grid = sorted(s_grid)
    rows = _banded(members, population.select(id_, y, *xs), id_, {0: grid}, None, ["replication", "role"])
    parts = moments_of(rows, xs, y, ["replication", "role", "band"])
    popvar = float(population.agg(F.var_samp(y)).first()[0])
    out = []
    for rep in sorted({k[0] for k in parts}):
        mine = {k[1:]: m for k, m in parts.items() if k[0] == rep}
        stop, scale = mine[("V_stop", -1)], mine[("V_scale", -1)]
        pool = {k[1]: m for k, m in mine.items() if k[0] == "L_prime"}
        n_eff = sum(m.n for m in pool.values())
        for i, s in enumerate(grid):
            train = _sum([m for k, m in pool.items() if k <= i])
            for method, cols in methods.items():
                score = fit_moments(train, cols, y)
                mean, square = score.residual(scale, y)
                smean, ssquare = score.residual(stop, y)
                out.append(
                    (method, rep, s, n_eff, popvar, variance(mean, square, scale.n), mean, math.sqrt(square), _corr(score, scale, y), variance(smean, ssquare, stop.n), ssquare)
                )
    return population.sparkSession.createDataFrame(out, CURVE_SCHEMA)
