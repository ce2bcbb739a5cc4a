"""Label allocation: summaries over replications, theory, oracle and savings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GROUP = ["budget", "method", "allocation_source", "rho", "s_train"]


def by_rho_summary(cells: DataFrame) -> DataFrame:
    """Means, spread, coverage and variance ratio over the replications of a cell."""
    n = F.count(F.lit(1))
    out = cells.groupBy(*GROUP).agg(
        F.count_distinct("replication").alias("n_replications"),
        F.avg("ppi_var_est").alias("mean_ppi_var_est"),
        F.when(n > 1, F.stddev_samp("ppi_var_est") / F.sqrt(n)).alias("se_ppi_var_est"),
        F.avg("mu_hat_ppi").alias("mean_mu_hat_ppi"),
        F.avg("target_mean").alias("mean_target_mean"),
        F.avg("sample_mean").alias("mean_sample_mean"),
        F.when(n > 1, F.stddev_samp("mu_hat_ppi")).alias("sd_mu_hat_ppi"),
        F.avg("ppi_error").alias("mean_error"),
        F.sqrt(F.avg(F.col("ppi_error") * F.col("ppi_error"))).alias("rmse_error"),
        F.avg(F.col("ppi_covered").cast("double")).alias("coverage"),
        F.avg("sample_mean_var_est").alias("mean_sample_var_est"),
        F.avg(F.col("sample_mean_covered").cast("double")).alias("sample_mean_coverage"),
    )
    half = F.lit(1.96) * F.col("sd_mu_hat_ppi") / F.sqrt("n_replications")
    return out.withColumns(
        {
            "ci95_low_mu_hat_ppi": F.col("mean_mu_hat_ppi") - half,
            "ci95_high_mu_hat_ppi": F.col("mean_mu_hat_ppi") + half,
            "var_ratio_to_sample_mean": F.try_divide(F.col("mean_ppi_var_est"), F.col("mean_sample_var_est")),
        }
    )


def theoretical_allocation(budgets: DataFrame, grid: Sequence[float] = (), keys: Sequence[str] = ("budget",)) -> DataFrame:
    """First integer s minimising (a s^-alpha + b) / (n_eff - s), and the nearest grid size.

    ``budgets`` carries a, alpha, b and n_eff per row.
    """
    rows = budgets.where(F.col("n_eff") > 1).withColumn("theory_s", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_eff") - 1)))
    objective = (F.col("a") * F.pow(F.col("theory_s").cast("double"), -F.col("alpha")) + F.col("b")) / (F.col("n_eff") - F.col("theory_s"))
    carried = [c for c in budgets.columns if c not in keys]
    best = rows.withColumn("o", objective).groupBy(*keys).agg(
        F.min(F.struct("o", "theory_s")).alias("best"), *[F.first(c).alias(c) for c in carried]
    )
    out = best.select(
        *keys,
        *carried,
        F.col("best.theory_s").alias("theory_s"),
        (F.col("best.theory_s") / F.col("n_eff")).alias("theory_rho"),
        F.col("best.o").alias("theory_objective"),
    )
    if not grid:
        return out
    from .splits import s_for_rho_column

    choices = F.array(
        *[
            F.struct(
                F.abs(s_for_rho_column(F.lit(r), F.col("n_eff")) - F.col("theory_s")).alias("gap"),
                F.lit(i).alias("i"),
                F.lit(float(r)).alias("rho"),
                s_for_rho_column(F.lit(r), F.col("n_eff")).alias("s"),
            )
            for i, r in enumerate(grid)
        ]
    )
    near = F.array_min(choices)
    return out.withColumn("theory_eval_rho", near["rho"]).withColumn("theory_eval_s", near["s"])


def oracle_allocation(summary: DataFrame, theory: DataFrame, theory_method: str, include_exact: bool = True, tol: float = 1e-10) -> DataFrame:
    """Least mean variance per (budget, method), the evaluated row and its regret.

    The theory method is evaluated at its theory cell (or the nearest grid
    cell), every other method at its own grid optimum.
    """
    exact_ok = (F.col("method") == theory_method) & F.lit(include_exact)
    pool = summary.where((F.col("allocation_source") == "grid") | exact_ok)
    first = W.partitionBy("budget", "method").orderBy("mean_ppi_var_est", "rho")
    best = (
        pool.withColumn("__r", F.row_number().over(first))
        .where(F.col("__r") == 1)
        .select(
            "budget",
            "method",
            F.col("rho").alias("grid_best_rho"),
            F.col("s_train").alias("grid_best_s"),
            F.col("allocation_source").alias("grid_best_source"),
            F.col("mean_ppi_var_est").alias("__best"),
        )
    )
    is_theory = F.col("method") == theory_method
    eval_rho = "theory_rho" if include_exact else "theory_eval_rho"
    wanted = best.join(theory.select("budget", "theory_rho", "theory_s", eval_rho if eval_rho != "theory_rho" else F.col("theory_rho").alias("__same")), "budget", "left")
    wanted = wanted.withColumns(
        {
            "eval_rho": F.when(is_theory, F.col(eval_rho)).otherwise(F.col("grid_best_rho")),
        }
    ).drop("__same", "theory_eval_rho")
    rows = summary.select(
        F.col("budget").alias("__b"),
        F.col("method").alias("__m"),
        F.col("rho").alias("__rho"),
        F.col("allocation_source").alias("eval_source"),
        F.col("s_train").alias("eval_s"),
        F.col("var_ratio_to_sample_mean").alias("var_ratio"),
        "coverage",
        "mean_error",
        "rmse_error",
        "mean_ppi_var_est",
        "mean_sample_var_est",
    )
    near = F.abs(F.col("__rho") - F.col("eval_rho")) <= tol
    # a theory size that falls on the grid has no cell of its own: the grid row stands for it
    joined = wanted.join(rows, (F.col("budget") == F.col("__b")) & (F.col("method") == F.col("__m")) & near, "left")
    guard = F.when(F.col("__b").isNull(), F.raise_error(F.lit("no evaluation row for a budget and method")).cast("double"))
    regret = F.try_divide(F.col("mean_ppi_var_est") - F.col("__best"), F.col("__best"))
    return joined.select(
        "budget",
        "method",
        F.when(is_theory, F.col("theory_rho")).alias("theory_rho"),
        F.when(is_theory, F.col("theory_s")).alias("theory_s"),
        F.when(is_theory & F.lit(include_exact), "grid+theory_exact").otherwise("grid").alias("oracle_candidate_set"),
        "grid_best_rho",
        "grid_best_s",
        "grid_best_source",
        "eval_source",
        "eval_rho",
        "eval_s",
        "var_ratio",
        guard.otherwise(F.when(is_theory, regret)).alias("regret"),
        "coverage",
        "mean_error",
        "rmse_error",
        "mean_ppi_var_est",
        "mean_sample_var_est",
    )


def sample_savings(cells: DataFrame, by: Sequence[str] = ("budget", "method", "rho")) -> DataFrame:
    """1 - Var(method) / Var(sample mean), averaged over replications, paired SE.

    A replication whose sample mean has no variance (all labels equal) has no ratio.
    """
    ratio = 1 - F.try_divide(F.col("ppi_var_est"), F.col("sample_mean_var_est"))
    n = F.count(F.lit(1))
    return cells.groupBy(*by).agg(
        n.alias("n_replications"),
        (1 - F.try_divide(F.avg("ppi_var_est"), F.avg("sample_mean_var_est"))).alias("var_reduction"),
        F.avg(ratio).alias("mean_paired_reduction"),
        F.when(n > 1, F.stddev_samp(ratio) / F.sqrt(n)).alias("paired_se"),
    )


def estimator_accuracy(
    cells: DataFrame,
    by: Sequence[str],
    error: str = "ppi_error",
    covered: str = "ppi_covered",
    replications: Sequence[int] = (),
    draws: int = 200,
    seed: int = 0,
) -> DataFrame:
    """RMSE, MAE and coverage over replications with standard errors.

    That of the RMSE is its spread over bootstrap draws of the ``replications``;
    without them it is left out.
    """
    n = F.count(F.lit(1))
    hit = F.col(covered).cast("double")
    rmse = F.sqrt(F.avg(F.col(error) * F.col(error)))
    accuracy = cells.groupBy(*by).agg(
        n.alias("n_replications"),
        F.sqrt(F.avg(F.col(error) * F.col(error))).alias("rmse"),
        F.avg(F.abs(F.col(error))).alias("mae"),
        F.when(n > 1, F.stddev_samp(F.abs(F.col(error))) / F.sqrt(n)).alias("mae_se"),
        F.avg(hit).alias("coverage"),
        F.when(n > 1, F.stddev_samp(hit) / F.sqrt(n)).alias("coverage_se"),
    )
    if not replications:
        return accuracy
    drawn = bootstrap(cells, by, "replication", replications, draws, seed).groupBy("draw", *by).agg(rmse.alias("rmse"))
    return accuracy.join(drawn.groupBy(*by).agg(F.stddev_samp("rmse").alias("rmse_se")), list(by))


def discrete_objective(v: Column, s: Column, n_eff: Column) -> Column:
    return F.when(n_eff - s > 0, v / (n_eff - s))


def bootstrap(
    cells: DataFrame, by: Sequence[str], replication: str, replications: Sequence[int], draws: int, seed: int
) -> DataFrame:
    """Resampled replications: each draw picks as many replications, with replacement, by hash.

    Adds column ``draw``; rows repeat as often as their replication is picked.
    """
    from ..functions.hashing import hash_key

    reps = F.array(*[F.lit(int(r)).cast("long") for r in replications])
    grid = cells.sparkSession.range(draws).withColumnRenamed("id", "draw")
    slots = grid.withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(len(replications)))))
    number = F.conv(F.substring(hash_key(seed, F.col("draw"), F.col("slot")), 1, 15), 16, 10).cast("long")
    picks = slots.select("draw", F.element_at(reps, (F.pmod(number, F.lit(len(replications))) + 1).cast("int")).alias(replication))
    return cells.join(F.broadcast(picks), replication)


def percentile_interval(df: DataFrame, by: Sequence[str], value: str, level: float = 0.95) -> DataFrame:
    """Percentile interval and spread over bootstrap draws (a bounded number per group)."""
    low, high = (1 - level) / 2, (1 + level) / 2
    q = F.percentile(value, F.array(F.lit(low), F.lit(high)))
    return df.groupBy(*by).agg(q.alias("q"), F.stddev_samp(value).alias("se"), F.count(value).alias("draws")).select(
        *by, F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"), "se", "draws"
    )
