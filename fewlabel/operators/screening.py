"""Budget tables, wins, rankings and progress reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def progress_eta(plan: DataFrame, done: DataFrame, keys: Sequence[str], method: str) -> DataFrame:
    """Completed and total cells, mean runtime and hours left, per method."""
    rows = plan.join(done, list(keys), "left")
    out = rows.groupBy(method).agg(
        F.count("runtime_seconds").alias("completed"),
        F.count(F.lit(1)).alias("total"),
        F.avg("runtime_seconds").alias("mean_runtime"),
    )
    left = F.greatest(F.col("total") - F.col("completed"), F.lit(0))
    return out.withColumn("remaining_hours", left * F.col("mean_runtime") / 3600)


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    """First k rows of each group; the groups of a report are short."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("__r") <= k).drop("__r")


def _with_budgets(rows: DataFrame, budgets: Sequence[int]) -> DataFrame:
    from .joins import budget_feasible

    return budget_feasible(rows, budgets)


def budget_best(scaling: DataFrame, direct: DataFrame, budgets: Sequence[int]) -> DataFrame:
    """Best feasible size per (feature, objective, budget) against direct labelling.

    ratio = (ifvar / (B - s)) / (direct / B) on the mean curve; the constant
    surrogate is not a candidate; the smaller size keeps a tie. A direct variance
    of zero gives no ratio and no win.
    """
    curve = (
        scaling.where(F.col("training_objective") != "constant")
        .groupBy("feature", "training_objective", "s")
        .agg(F.avg("ifvar").alias("ifvar"))
        .join(direct.select("feature", "direct_ifvar"), "feature")
    )
    rows = _with_budgets(curve, budgets)
    direct_share = F.try_divide(F.col("direct_ifvar"), F.col("budget"))
    ratio = F.try_divide(F.try_divide(F.col("ifvar"), F.col("budget") - F.col("s")), direct_share)
    rows = rows.withColumn("variance_ratio_vs_direct", ratio)
    best = top_per_group(rows, ["feature", "training_objective", "budget"], [F.col("variance_ratio_vs_direct").asc_nulls_last(), F.col("s")])
    return best.select(
        "feature",
        "training_objective",
        "budget",
        F.col("s").alias("best_s"),
        F.col("ifvar").alias("best_ifvar"),
        "variance_ratio_vs_direct",
        (F.col("variance_ratio_vs_direct") < 1).alias("wins"),
        ((1 - F.col("variance_ratio_vs_direct")) * 100).alias("win_margin_pct"),
    )


def budget_rows(results: DataFrame, budgets: Sequence[int]) -> DataFrame:
    """Every feasible (row, budget): ratios against direct OLS and the zero surrogate."""
    rows = _with_budgets(results, budgets)

    def ratio(base: str) -> Column:
        own = F.col("ifvar") / (F.col("budget") - F.col("s"))
        return F.when(F.col(base) > 0, own / (F.col(base) / F.col("budget")))

    out = rows.withColumns({"ratio_vs_direct_ols": ratio("direct_ols_ifvar"), "ratio_vs_zero_surrogate": ratio("zero_ifvar")})
    return out.withColumns(
        {
            "beats_direct_ols": F.coalesce(F.col("ratio_vs_direct_ols") < 1, F.lit(False)),
            "beats_zero_surrogate": F.coalesce(F.col("ratio_vs_zero_surrogate") < 1, F.lit(False)),
        }
    )


# Training sizes of the cheap feasibility proxy.
PROXY_SIZES = (50, 100, 250, 500, 750, 1000, 1500)


def budget_proxy(candidates: DataFrame, budgets: Sequence[int], sizes: Sequence[int] = PROXY_SIZES) -> DataFrame:
    """One fixed surrogate IF variance against the zero surrogate, over proxy sizes."""
    rows = candidates.withColumn("s", F.explode(F.array(*[F.lit(int(s)).cast("long") for s in sizes])))
    rows = _with_budgets(rows, budgets)
    zero = F.col("zero_surrogate_ifvar")
    ratio = F.when(zero > 0, (F.col("tfidf_ifvar") / (F.col("budget") - F.col("s"))) / (zero / F.col("budget")))
    return rows.select(
        "feature", "budget", F.col("s").alias("s_proxy"), ratio.alias("ratio"), F.coalesce(ratio < 1, F.lit(False)).alias("passes_proxy")
    )


def budget_threshold(scaling: DataFrame, keys: Sequence[str], budgets: Sequence[int]) -> DataFrame:
    """Smallest winning size (mean ratio below (B - s) / B), else the best ratio; one row per budget."""
    keys = list(keys)
    curve = scaling.groupBy(*keys, "s").agg(
        F.avg("ifvar").alias("mean_ifvar"), F.avg("ifvar_ratio_to_s0").alias("mean_ratio"),
        F.percentile("ifvar_ratio_to_s0", F.lit(0.5)).alias("median_ratio"),
    )
    all_budgets = F.explode(F.array(*[F.lit(int(b)).cast("long") for b in budgets]))
    base = curve.select(*keys).distinct().withColumn("budget", all_budgets)
    rows = _with_budgets(curve.where(F.col("s") > 0), budgets).withColumn(
        "win_threshold", (F.col("budget") - F.col("s")) / F.col("budget")
    )
    wins = F.coalesce(F.col("mean_ratio") < F.col("win_threshold"), F.lit(False))
    rows = rows.withColumn("wins", wins)
    order = [F.col("wins").desc(), F.when(F.col("wins"), F.col("s")), F.col("mean_ratio").asc_nulls_last(), F.col("s")]
    best = top_per_group(rows, [*keys, "budget"], order)
    out = base.join(best, [*keys, "budget"], "left")
    return out.select(
        *keys,
        "budget",
        F.coalesce("wins", F.lit(False)).alias("wins"),
        F.col("s").alias("best_s"),
        F.col("mean_ratio").alias("best_mean_ratio"),
        F.col("win_threshold").alias("win_threshold_at_best_s"),
    )


def budget_summary(rows: DataFrame, by: Sequence[str] = ("target", "method", "s", "budget")) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.avg("ratio_vs_direct_ols").alias("mean_ratio_vs_direct_ols"),
        F.avg("ratio_vs_zero_surrogate").alias("mean_ratio_vs_zero_surrogate"),
        F.avg(F.col("beats_direct_ols").cast("double")).alias("win_rate_direct_ols"),
        F.avg(F.col("beats_zero_surrogate").cast("double")).alias("win_rate_zero_surrogate"),
    )


def win_counts(table: DataFrame, by: Sequence[str]) -> DataFrame:
    return table.groupBy(*by).agg(F.sum(F.col("wins").cast("long")).alias("n_winning"))


def _clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


# Fixed values in screen_score: the thresholds of the flags, their points and the weights of the score.
def screen_score(d: DataFrame) -> DataFrame:
    """Pass flags of the headline screen, the weighted score and the sorted rank."""
    flags = d.withColumns(
        {
            "passes_nonzero": F.col("nonzero_share") >= 0.50,
            "passes_if_weights": (F.col("if_weight_p99_abs") <= 10) & (F.col("if_ess_share") >= 0.15),
            "passes_collinearity": F.coalesce((F.col("target_vif") <= 5) & (F.col("hessian_condition") <= 25), F.lit(False)),
            "passes_coef": F.col("abs_beta_controlled") >= 0.02,
            "passes_tfidf_proxy": F.coalesce(F.col("tfidf_ifvar_ratio_vs_zero") < 0.95, F.lit(False)),
        }
    )
    points = {"passes_nonzero": 20, "passes_if_weights": 20, "passes_collinearity": 20, "passes_coef": 15, "passes_tfidf_proxy": 15}
    score = F.lit(0.0)
    for c, p in points.items():
        score = score + F.col(c).cast("int") * p
    score = (
        score
        + (4 - _clip(F.col("priority"), 0, 4)) * 2
        + _clip(F.col("abs_beta_controlled"), 0, 0.2) * 10
        - _clip(F.col("tfidf_ifvar_ratio_vs_zero"), 0, 2) * 2
    )
    order = W.orderBy(
        F.col("screen_score").desc_nulls_last(), F.col("passes_tfidf_proxy").desc(), F.col("abs_beta_controlled").desc(), F.col("if_weight_p99_abs"), "feature"
    )
    # one row per candidate feature, so a single ordering is small
    return flags.withColumn("screen_score", score).withColumn("rank", F.row_number().over(order).cast("long"))


# Report priority of the preference targets.
TARGET_PRIORITY = {"delta_format": 0, "delta_prompt_coverage": 1, "delta_log_length": 2}


def rank_targets(summary: DataFrame) -> DataFrame:
    """Controlled rows by stability, size of the coefficient, weights and priority."""
    rows = summary.where(F.col("model") == "controlled")
    stable = (F.col("nonzero_share") >= 0.10) & (F.col("if_weight_p99") <= 10) & F.coalesce(F.col("hessian_condition") <= 1e6, F.lit(False))
    priority = F.lit(9)
    for name, p in TARGET_PRIORITY.items():
        priority = F.when(F.regexp_replace("target", "_scale$", "") == name, F.lit(p)).otherwise(priority)
    rows = rows.withColumns({"stable": stable, "priority": priority})
    order = W.orderBy(F.col("stable").desc(), F.col("abs_beta").desc(), F.col("if_weight_p99"), F.col("priority"), "target")
    return rows.withColumn("rank", F.row_number().over(order).cast("long"))


def ranked_shortlist(candidates: DataFrame, budget: DataFrame, objectives: Sequence[str]) -> DataFrame:
    """Candidates with their best ratio per objective, any win, the rank key and the rank by four keys."""
    best = budget.groupBy("feature", "training_objective").agg(
        F.min("variance_ratio_vs_direct").alias("best_ratio"), F.max("wins").alias("wins_any")
    )
    wide = best.groupBy("feature").pivot("training_objective", list(objectives)).agg(F.first("best_ratio"))
    wins = best.groupBy("feature").agg(F.max("wins_any").alias("wins_any_budget"))
    out = candidates.join(wide, "feature", "left").join(wins, "feature", "left")
    plain = [o for o in ("mse", "mse_stop_ifvar") if o in objectives]
    baseline = (F.least(*plain) if len(plain) > 1 else F.col(plain[0])) if plain else F.lit(float("inf"))
    own = "ifvar_exact" if "ifvar_exact" in objectives else "ifvar_weighted" if "ifvar_weighted" in objectives else None
    beats = F.coalesce(F.col(own) < baseline, F.lit(False)) if own else F.lit(False)
    size = F.dense_rank().over(W.orderBy(F.col("abs_beta_raw_points").desc()))
    key = (
        (~F.col("passes_stability")).cast("int") * 100
        + (~F.coalesce("wins_any_budget", F.lit(False))).cast("int") * 20
        + F.col("priority")
        - size / 100.0
    )
    keyed = out.withColumns({"ifvar_beats_mse": beats, "rank_key": key})
    present = [F.col(o).asc_nulls_last() for o in ("ifvar_weighted", "mse") if o in objectives]
    order = W.orderBy(F.col("rank_key").asc_nulls_last(), *present, "feature")
    # one row per candidate feature, so a single ordering is small
    return keyed.withColumn("rank", F.row_number().over(order).cast("long"))


def rank_specs(summary: DataFrame, scaling: DataFrame, budget_table: DataFrame) -> DataFrame:
    """Specs with best mean ratio and smallest winning budget, in the seven-key order."""
    means = scaling.where(F.col("s") > 0).groupBy("spec_id", "s").agg(
        F.avg("ifvar_ratio_to_s0").alias("best_mean_ratio"), F.percentile("ifvar_ratio_to_s0", F.lit(0.5)).alias("best_median_ratio")
    )
    best = top_per_group(means, ["spec_id"], [F.col("best_mean_ratio").asc_nulls_last(), F.col("s")]).withColumnRenamed("s", "best_s")
    wins = top_per_group(budget_table.where(F.col("wins")), ["spec_id"], [F.col("budget"), F.col("best_s")]).select(
        "spec_id",
        F.col("budget").alias("smallest_winning_budget"),
        F.col("best_s").alias("best_s_at_smallest_winning_budget"),
        F.col("best_mean_ratio").alias("best_ratio_at_smallest_winning_budget"),
        F.col("win_threshold_at_best_s").alias("threshold_at_smallest_winning_budget"),
    )
    out = summary.join(best, "spec_id", "left").join(wins, "spec_id", "left")
    order = W.orderBy(
        F.col("passes_stability").desc(),
        F.col("smallest_winning_budget").asc_nulls_last(),
        F.col("management_priority"),
        F.col("abs_beta").desc(),
        F.col("best_mean_ratio").asc_nulls_last(),
        F.col("dimension"),
        F.col("if_weight_p99"),
        F.col("spec_id"),
    )
    return out.withColumn("rank", F.row_number().over(order).cast("long"))


def partial_metrics(cells: DataFrame, by: Sequence[str] = ("method", "s")) -> DataFrame:
    """By method and size (and more keys): finished cells, mean ratios, and the baseline of the first replication."""
    return cells.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("ifvar").alias("mean_ifvar"),
        F.avg(F.when(F.col("const_ifvar") != 0, F.col("ifvar") / F.col("const_ifvar"))).alias("mean_ratio_const"),
        F.avg(F.when(F.col("direct_ifvar") != 0, F.col("ifvar") / F.col("direct_ifvar"))).alias("mean_ratio_direct"),
        F.min_by("direct_ifvar", "replication").alias("direct"),
    )
