"""Budget tables, wins, rankings and reports.

The scaling table is taken from the line items: feature = return flag,
objective = line status, replication = supplier class, size = 100 x line number.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import screening as R
from . import sqlparts as S
from .data import load
from .project_queries import preference_frame
from .registry import query, shaped, sql_shaped
from .regression_queries import _PT, _coef_sql

SCAL = """scal AS (SELECT l_returnflag AS feature, CASE l_linestatus WHEN 'O' THEN 'mse' ELSE 'ifvar_weighted' END AS training_objective, l_suppkey % 4 AS replication, (l_linenumber * 100)::BIGINT AS s,
  var_samp(l_extendedprice / 10000) / (1 + ln(any_value(l_linenumber))) AS ifvar FROM lineitem GROUP BY ALL),
cand AS (SELECT l_returnflag AS feature, var_samp(l_extendedprice / 10000) AS direct_ifvar, avg(l_quantity) AS abs_beta_raw_points, (l_returnflag = 'N')::INT AS priority, l_returnflag <> 'R' AS passes_stability FROM lineitem GROUP BY ALL),
ratio AS (SELECT *, ifvar / direct_ifvar AS ifvar_ratio_to_s0 FROM scal JOIN cand USING (feature))"""
BUDGETS = (250, 500, 1000)
_B = "(VALUES (250), (500), (1000)) AS b(budget)"


def scaling(spark, sf):
    line = F.col("l_linenumber")
    rows = load(spark, sf, "lineitem").groupBy(
        F.col("l_returnflag").alias("feature"),
        F.when(F.col("l_linestatus") == "O", "mse").otherwise("ifvar_weighted").alias("training_objective"),
        (F.col("l_suppkey") % 4).alias("replication"),
        "l_linenumber",
    ).agg(F.var_samp(F.col("l_extendedprice") / 10000).alias("v"))
    return rows.select("feature", "training_objective", "replication", (line * 100).cast("long").alias("s"), (F.col("v") / (1 + F.log(line))).alias("ifvar"))


def candidates(spark, sf):
    return load(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("feature")).agg(
        F.var_samp(F.col("l_extendedprice") / 10000).alias("direct_ifvar"), F.avg("l_quantity").alias("abs_beta_raw_points")
    ).withColumns({"priority": (F.col("feature") == "N").cast("int"), "passes_stability": F.col("feature") != "R"})


def ratios(spark, sf):
    out = scaling(spark, sf).join(F.broadcast(candidates(spark, sf).select("feature", "direct_ifvar")), "feature")
    return out.withColumn("ifvar_ratio_to_s0", F.col("ifvar") / F.col("direct_ifvar"))


_BEST = f"""best AS (SELECT feature, training_objective, budget::BIGINT AS budget, s AS best_s, ifvar AS best_ifvar, ratio AS variance_ratio_vs_direct, ratio < 1 AS wins, (1 - ratio) * 100 AS win_margin_pct FROM (
  SELECT *, row_number() OVER (PARTITION BY feature, training_objective, budget ORDER BY ratio, s) AS r FROM (
  SELECT c.feature, training_objective, s, budget, ifvar, (ifvar / (budget - s)) / (direct_ifvar / budget) AS ratio FROM (SELECT feature, training_objective, s, avg(ifvar) AS ifvar FROM scal GROUP BY ALL) c JOIN cand USING (feature) JOIN {_B} ON s < budget)) WHERE r = 1)"""


@query("budget_best", sql_shaped("SELECT * FROM best", ["feature", "training_objective", "budget", "best_s", "wins"], ["best_ifvar", "variance_ratio_vs_direct", "win_margin_pct"], with_=f"WITH {SCAL},\n{_BEST}"))
def budget_best(spark, sf):
    out = R.budget_best(scaling(spark, sf), candidates(spark, sf), BUDGETS)
    return shaped(out, ["feature", "training_objective", "budget", "best_s", "wins"], ["best_ifvar", "variance_ratio_vs_direct", "win_margin_pct"])


def result_rows(spark, sf):
    return ratios(spark, sf).select(
        F.col("feature").alias("target"), F.col("training_objective").alias("method"), "replication", "s", "ifvar", F.col("direct_ifvar").alias("direct_ols_ifvar"), (F.col("direct_ifvar") * 0.8).alias("zero_ifvar")
    )


_ROWS = f"""rows AS (SELECT *, d < 1 AS beats_direct_ols, z < 1 AS beats_zero_surrogate, d AS ratio_vs_direct_ols, z AS ratio_vs_zero_surrogate FROM (
  SELECT feature AS target, training_objective AS method, replication, s, budget::BIGINT AS budget, (ifvar / (budget - s)) / (direct_ifvar / budget) AS d, (ifvar / (budget - s)) / (direct_ifvar * 0.8 / budget) AS z FROM ratio JOIN {_B} ON s < budget))"""
_RK = ["target", "method", "replication", "s", "budget", "beats_direct_ols", "beats_zero_surrogate"]


@query("budget_rows", sql_shaped("SELECT * FROM rows", _RK, ["ratio_vs_direct_ols", "ratio_vs_zero_surrogate"], with_=f"WITH {SCAL},\n{_ROWS}"))
def budget_rows(spark, sf):
    return shaped(R.budget_rows(result_rows(spark, sf), BUDGETS), _RK, ["ratio_vs_direct_ols", "ratio_vs_zero_surrogate"])


_SUM = ["mean_ratio_vs_direct_ols", "mean_ratio_vs_zero_surrogate", "win_rate_direct_ols", "win_rate_zero_surrogate"]


@query("budget_summary", sql_shaped("SELECT target, method, s, budget, avg(d) AS mean_ratio_vs_direct_ols, avg(z) AS mean_ratio_vs_zero_surrogate, avg(beats_direct_ols::INT) AS win_rate_direct_ols, avg(beats_zero_surrogate::INT) AS win_rate_zero_surrogate FROM rows GROUP BY ALL", ["target", "method", "s", "budget"], _SUM, with_=f"WITH {SCAL},\n{_ROWS}"))
def budget_summary(spark, sf):
    return shaped(R.budget_summary(R.budget_rows(result_rows(spark, sf), BUDGETS)), ["target", "method", "s", "budget"], _SUM)


_PROXY = """proxy AS (SELECT p_brand AS feature, var_samp(p_retailprice) AS zero_surrogate_ifvar, var_pop(p_retailprice) * (0.5 + avg(p_size) / 60) AS tfidf_ifvar FROM part GROUP BY 1)"""


def proxies(spark, sf):
    return load(spark, sf, "part").groupBy(F.col("p_brand").alias("feature")).agg(
        F.var_samp("p_retailprice").alias("zero_surrogate_ifvar"), (F.var_pop("p_retailprice") * (0.5 + F.avg("p_size") / 60)).alias("tfidf_ifvar")
    )


@query(
    "budget_proxy",
    sql_shaped(f"SELECT feature, budget::BIGINT AS budget, s::BIGINT AS s_proxy, (tfidf_ifvar / (budget - s)) / (zero_surrogate_ifvar / budget) AS ratio, (tfidf_ifvar / (budget - s)) / (zero_surrogate_ifvar / budget) < 1 AS passes_proxy FROM proxy, (SELECT unnest([50, 100, 250, 500, 750, 1000, 1500]) AS s), (VALUES (500), (1000), (3000)) AS b(budget) WHERE s < budget", ["feature", "budget", "s_proxy", "passes_proxy"], ["ratio"], with_=f"WITH {_PROXY}"),
)
def budget_proxy(spark, sf):
    return shaped(R.budget_proxy(proxies(spark, sf), (500, 1000, 3000)), ["feature", "budget", "s_proxy", "passes_proxy"], ["ratio"])


_THR = """spec AS (SELECT feature || '_' || training_objective AS spec_id, CASE training_objective WHEN 'mse' THEN 1 ELSE 2 END AS dimension, replication, s, ifvar, ifvar_ratio_to_s0 FROM ratio),
scurve AS (SELECT spec_id, dimension, s, avg(ifvar_ratio_to_s0) AS m, quantile_cont(ifvar_ratio_to_s0, 0.5) AS med FROM spec GROUP BY ALL),
thr AS (SELECT spec_id, dimension, budget::BIGINT AS budget, m < t AS wins, s AS best_s, m AS best_mean_ratio, t AS win_threshold_at_best_s FROM (
  SELECT *, row_number() OVER (PARTITION BY spec_id, budget ORDER BY (m < t) DESC, CASE WHEN m < t THEN s END, m, s) AS r FROM (SELECT *, (budget - s) / budget::DOUBLE AS t FROM scurve JOIN (VALUES (150), (250), (500), (1000)) AS b(budget) ON s < budget)) WHERE r = 1)"""
THR_B = (150, 250, 500, 1000)


def specs(spark, sf):
    return ratios(spark, sf).select(
        F.concat_ws("_", "feature", "training_objective").alias("spec_id"), F.when(F.col("training_objective") == "mse", 1).otherwise(2).alias("dimension"), "replication", "s", "ifvar", "ifvar_ratio_to_s0"
    )


@query("budget_threshold", sql_shaped("SELECT * FROM thr", ["spec_id", "dimension", "budget", "wins", "best_s"], ["best_mean_ratio", "win_threshold_at_best_s"], with_=f"WITH {SCAL},\n{_THR}"))
def budget_threshold(spark, sf):
    out = R.budget_threshold(specs(spark, sf), ["spec_id", "dimension"], THR_B)
    return shaped(out, ["spec_id", "dimension", "budget", "wins", "best_s"], ["best_mean_ratio", "win_threshold_at_best_s"])


@query("win_counts", f"WITH {SCAL},\n{_THR} SELECT budget, dimension, sum(wins::INT)::BIGINT AS n_winning FROM thr GROUP BY ALL")
def win_counts(spark, sf):
    return R.win_counts(R.budget_threshold(specs(spark, sf), ["spec_id", "dimension"], THR_B), ["budget", "dimension"])


_SPECS = """summary AS (SELECT l_returnflag || '_' || CASE l_linestatus WHEN 'O' THEN 'mse' ELSE 'ifvar_weighted' END AS spec_id, CASE l_linestatus WHEN 'O' THEN 1 ELSE 2 END AS dimension, avg(l_tax) AS abs_beta, max(l_quantity) / 6 AS if_weight_p99, count(*) > 9000 AS passes_stability, (l_returnflag = 'N')::INT AS management_priority FROM lineitem GROUP BY l_returnflag, l_linestatus)"""


@query(
    "rank_specs",
    sql_shaped(
        """SELECT *, row_number() OVER (ORDER BY passes_stability DESC, smallest_winning_budget NULLS LAST, management_priority, abs_beta DESC, best_mean_ratio, dimension, if_weight_p99, spec_id) AS rank FROM summary
        LEFT JOIN (SELECT spec_id, s AS best_s, m AS best_mean_ratio, med AS best_median_ratio FROM (SELECT *, row_number() OVER (PARTITION BY spec_id ORDER BY m, s) AS r FROM scurve) WHERE r = 1) USING (spec_id)
        LEFT JOIN (SELECT spec_id, budget AS smallest_winning_budget, best_s AS best_s_at_smallest_winning_budget FROM (SELECT *, row_number() OVER (PARTITION BY spec_id ORDER BY budget, best_s) AS r FROM thr WHERE wins) WHERE r = 1) USING (spec_id)""",
        ["spec_id", "rank", "best_s", "smallest_winning_budget", "best_s_at_smallest_winning_budget"],
        ["best_mean_ratio", "best_median_ratio"],
        with_=f"WITH {SCAL},\n{_THR},\n{_SPECS}",
    ),
)
def rank_specs(spark, sf):
    line = load(spark, sf, "lineitem")
    summary = line.groupBy("l_returnflag", "l_linestatus").agg(
        F.avg("l_tax").alias("abs_beta"), (F.max("l_quantity") / 6).alias("if_weight_p99"), (F.count(F.lit(1)) > 9000).alias("passes_stability")
    ).select(
        F.concat_ws("_", "l_returnflag", F.when(F.col("l_linestatus") == "O", "mse").otherwise("ifvar_weighted")).alias("spec_id"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(2).alias("dimension"),
        "abs_beta", "if_weight_p99", "passes_stability", (F.col("l_returnflag") == "N").cast("int").alias("management_priority"),
    )
    s = specs(spark, sf)
    out = R.rank_specs(summary, s, R.budget_threshold(s, ["spec_id", "dimension"], THR_B))
    return shaped(out, ["spec_id", "rank", "best_s", "smallest_winning_budget", "best_s_at_smallest_winning_budget"], ["best_mean_ratio", "best_median_ratio"])


@query(
    "ranked_shortlist",
    sql_shaped(
        """SELECT *, row_number() OVER (ORDER BY rank_key, ifvar_weighted NULLS LAST, mse NULLS LAST, feature) AS rank FROM (SELECT c.feature, mse, ifvar_weighted, wins_any_budget, coalesce(ifvar_weighted < mse, false) AS ifvar_beats_mse,
          (NOT passes_stability)::INT * 100 + (NOT coalesce(wins_any_budget, false))::INT * 20 + priority - dense_rank() OVER (ORDER BY abs_beta_raw_points DESC) / 100.0 AS rank_key
        FROM cand c LEFT JOIN (SELECT feature, min(variance_ratio_vs_direct) FILTER (training_objective = 'mse') AS mse, min(variance_ratio_vs_direct) FILTER (training_objective = 'ifvar_weighted') AS ifvar_weighted, bool_or(wins) AS wins_any_budget FROM best GROUP BY feature) USING (feature))""",
        ["feature", "wins_any_budget", "ifvar_beats_mse", "rank"],
        ["mse", "ifvar_weighted", "rank_key"],
        with_=f"WITH {SCAL},\n{_BEST}",
    ),
)
def ranked_shortlist(spark, sf):
    c = candidates(spark, sf)
    out = R.ranked_shortlist(c, R.budget_best(scaling(spark, sf), c, BUDGETS), ["mse", "ifvar_weighted"])
    return shaped(out, ["feature", "wins_any_budget", "ifvar_beats_mse", "rank"], ["mse", "ifvar_weighted", "rank_key"])


_DIAG = """diag AS (SELECT p_brand AS feature, avg((p_size > 20)::INT) AS nonzero_share, max(p_size) / 5.0 AS if_weight_p99_abs, avg(p_size) / 50 AS if_ess_share, stddev_pop(p_size) / 4 AS target_vif, max(p_retailprice) / 50 AS hessian_condition,
  abs(corr(p_size, p_retailprice)) AS abs_beta_controlled, 0.5 + avg(p_size) / 50 AS tfidf_ifvar_ratio_vs_zero, (min(p_size) % 5)::INT AS priority FROM part GROUP BY p_brand)"""
_FLAGS = ["passes_nonzero", "passes_if_weights", "passes_collinearity", "passes_coef", "passes_tfidf_proxy"]


@query(
    "screen_score",
    sql_shaped(
        """SELECT *, row_number() OVER (ORDER BY screen_score DESC, passes_tfidf_proxy DESC, abs_beta_controlled DESC, if_weight_p99_abs, feature) AS rank FROM (
        SELECT *, passes_nonzero::INT * 20 + passes_if_weights::INT * 20 + passes_collinearity::INT * 20 + passes_coef::INT * 15 + passes_tfidf_proxy::INT * 15 + (4 - least(greatest(priority, 0), 4)) * 2 + least(abs_beta_controlled, 0.2) * 10 - least(tfidf_ifvar_ratio_vs_zero, 2) * 2 AS screen_score FROM (
        SELECT *, nonzero_share >= 0.5 AS passes_nonzero, if_weight_p99_abs <= 10 AND if_ess_share >= 0.15 AS passes_if_weights, target_vif <= 5 AND hessian_condition <= 25 AS passes_collinearity, abs_beta_controlled >= 0.02 AS passes_coef, tfidf_ifvar_ratio_vs_zero < 0.95 AS passes_tfidf_proxy FROM diag))""",
        ["feature", "rank", *_FLAGS],
        ["screen_score"],
        with_=f"WITH {_DIAG}",
    ),
)
def screen_score(spark, sf):
    d = load(spark, sf, "part").groupBy(F.col("p_brand").alias("feature")).agg(
        F.avg((F.col("p_size") > 20).cast("int")).alias("nonzero_share"),
        (F.max("p_size") / 5.0).alias("if_weight_p99_abs"),
        (F.avg("p_size") / 50).alias("if_ess_share"),
        (F.stddev_pop("p_size") / 4).alias("target_vif"),
        (F.max("p_retailprice") / 50).alias("hessian_condition"),
        F.abs(F.corr("p_size", "p_retailprice")).alias("abs_beta_controlled"),
        (0.5 + F.avg("p_size") / 50).alias("tfidf_ifvar_ratio_vs_zero"),
        (F.min("p_size") % 5).cast("int").alias("priority"),
    )
    return shaped(R.screen_score(d), ["feature", "rank", *_FLAGS], ["screen_score"])


@query(
    "rank_targets",
    sql_shaped(
        f"""SELECT target, stable, priority, abs_beta, row_number() OVER (ORDER BY stable DESC, abs_beta DESC, if_weight_p99, priority, target) AS rank FROM (
        SELECT target, abs(beta) AS abs_beta, if_weight_p99, nonzero_share >= 0.1 AND if_weight_p99 <= 10 AND min(raw_sd) OVER () > 0 AS stable,
          CASE target WHEN 'delta_format_scale' THEN 0 WHEN 'delta_prompt_coverage_scale' THEN 1 WHEN 'delta_log_length_scale' THEN 2 ELSE 9 END AS priority FROM ({_coef_sql()}) WHERE model = 'controlled')""",
        ["target", "stable", "priority", "rank"],
        ["abs_beta"],
    ),
)
def rank_targets(spark, sf):
    from ..plans.screening import coef_summary

    out = R.rank_targets(coef_summary(preference_frame(spark, sf), _PT, _PT, "y_preference_strength"))
    return shaped(out, ["target", "stable", "priority", "rank"], ["abs_beta"])


@query(
    "topk_per_group",
    sql_shaped("SELECT target, budget, method, replication, s, d AS ratio_vs_direct_ols FROM (SELECT *, row_number() OVER (PARTITION BY target, budget ORDER BY d, method, replication, s) AS r FROM rows) WHERE r <= 3", ["target", "budget", "method", "replication", "s"], ["ratio_vs_direct_ols"], with_=f"WITH {SCAL},\n{_ROWS}"),
)
def topk_per_group(spark, sf):
    rows = R.budget_rows(result_rows(spark, sf), BUDGETS)
    out = R.top_per_group(rows, ["target", "budget"], [F.col(c) for c in ("ratio_vs_direct_ols", "method", "replication", "s")], 3)
    return shaped(out, ["target", "budget", "method", "replication", "s"], ["ratio_vs_direct_ols"])


_PM = ["mean_ifvar", "mean_ratio_const", "mean_ratio_direct", "direct"]


@query(
    "partial_metrics",
    sql_shaped(
        "SELECT feature, training_objective AS method, s, count(*)::BIGINT AS n, avg(ifvar) AS mean_ifvar, avg(ifvar / (direct_ifvar * 1.25)) AS mean_ratio_const, avg(ifvar / direct_ifvar) AS mean_ratio_direct, arg_min(direct_ifvar, replication) AS direct FROM ratio GROUP BY ALL",
        ["feature", "method", "s", "n"],
        _PM,
        with_=f"WITH {SCAL}",
    ),
)
def partial_metrics(spark, sf):
    rows = ratios(spark, sf).select(
        "feature", F.col("training_objective").alias("method"), "replication", "s", "ifvar", (F.col("direct_ifvar") * 1.25).alias("const_ifvar"), "direct_ifvar"
    )
    return shaped(R.partial_metrics(rows, ["feature", "method", "s"]), ["feature", "method", "s", "n"], _PM)
