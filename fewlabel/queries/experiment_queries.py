"""Corrected means, allocation grids and scaling laws."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import allocation as A
from ..operators import joins as J
from ..operators import ppi as P
from ..operators import scaling_law as L
from ..operators import splits as X
from ..plans import allocation as G
from ..plans import populations as POP
from ..session import materialise
from ..sources import metrics as MT
from ..sources import sinks
from . import sqlparts as S
from .data import load
from .project_queries import orders_split, scratch
from .registry import query, rounded, shaped, sql_shaped
from .regression_queries import fit2

BUDGETS = (300, 500, 700, 1000)
RHOS = (0.025, 0.05, 0.075, 0.10, 0.125, 0.15, 0.20, 0.30, 0.40, 0.50, 0.70, 0.90)
REPS = tuple(range(5))
S_GRID = tuple(range(50, 701, 50))
METHODS = {"lines": ["x1"], "quantity": ["x2"]}

# --- the pilot curve --------------------------------------------------------------


def pilot_curve(spark, sf):
    """Residual variance by training size on the pilot part of the orders."""
    h = materialise(orders_split(spark, sf).where(F.col("split") == "h_scale"), "pilot")
    members = X.replication_split(h, "id", REPS, 2000, 300, 700, seed=71)
    return G.scaling_curve(h, members, METHODS, "y", "id", S_GRID)


def fit_points(curve):
    return curve.select(
        "method", "replication", "s", "n_eff", F.col("scale_residual_var").alias("value"), F.col("population_var").alias("b_upper")
    )


def _long(name: str, base: str) -> str:
    return f"{name} AS (SELECT id, y, 'lines' AS method, x1 AS x FROM {base} UNION ALL SELECT id, y, 'quantity', x2 FROM {base})"


PILOT = S.ORD + f""",
hs AS (SELECT id, y, x1, x2 FROM ord_split WHERE split = 'h_scale'),
{_long('hl', 'hs')},
pmem AS (SELECT replication, id, CASE WHEN rank <= 300 THEN 'V_stop' WHEN rank <= 1000 THEN 'V_scale' ELSE 'L_prime' END AS role, rank - 1000 AS train_rank FROM (
  SELECT replication, id, row_number() OVER (PARTITION BY replication ORDER BY md5(concat_ws(':', 71, replication, 'replication', id)), id) AS rank
  FROM hs, (SELECT unnest(range(5)) AS replication)) WHERE rank <= 2000),
ptr AS (SELECT method, replication, s, regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0 FROM hl JOIN pmem USING (id)
  JOIN (SELECT unnest(range(50, 701, 50)) AS s) ON role = 'L_prime' AND train_rank <= s GROUP BY ALL),
curve AS (SELECT method, replication, s, 1000::BIGINT AS n_eff, (SELECT var_samp(y) FROM hs) AS population_var,
  var_samp(r) FILTER (role = 'V_scale') AS scale_residual_var, avg(r) FILTER (role = 'V_scale') AS scale_residual_mean,
  sqrt(avg(r * r) FILTER (role = 'V_scale')) AS scale_rmse, corr(y, f) FILTER (role = 'V_scale') AS scale_corr,
  var_samp(r) FILTER (role = 'V_stop') AS stop_residual_var, avg(r * r) FILTER (role = 'V_stop') AS stop_mse
  FROM (SELECT method, replication, s, role, y, b0 + b1 * x AS f, y - b0 - b1 * x AS r FROM ptr JOIN pmem USING (replication) JOIN hl USING (id, method) WHERE role <> 'L_prime') GROUP BY ALL),
pts AS (SELECT method, replication, s, n_eff, scale_residual_var AS v, population_var AS bu FROM curve)"""

_CURVE = ["population_var", "scale_residual_var", "scale_residual_mean", "scale_rmse", "scale_corr", "stop_residual_var", "stop_mse"]


@query("scaling_curve", sql_shaped("SELECT * FROM curve", ["method", "replication", "s", "n_eff"], _CURVE, with_=f"WITH {PILOT}"))
def scaling_curve(spark, sf):
    return shaped(pilot_curve(spark, sf), ["method", "replication", "s", "n_eff"], _CURVE)


def fit_sql(name: str, points: str, keys: str, lo: float = 0.02, hi: float = 1.5, min_points: int = 3) -> str:
    """Bounded power-law fit over a relation (keys, s, v, bu), as CTEs ending in {name}."""
    grid = round((hi - lo) / 0.005)
    ok = "a0 >= 1e-12 AND b0 >= 0 AND b0 <= bu"

    def tried(tag: str, source: str, cols: str) -> list[str]:
        """Bounded least squares and error of every (curve, alpha) of a relation."""
        return [
            f"{name}_g{tag} AS (SELECT *, pow(s, -alpha) AS u FROM {source} WHERE n >= {min_points})",
            f"""{name}_f{tag} AS (SELECT {cols}, alpha, any_value(bu) AS bu, regr_slope(v, u) AS a0, regr_intercept(v, u) AS b0, sum(u * v) / sum(u * u) AS al,
              (sum(u * v) - any_value(bu) * sum(u)) / sum(u * u) AS au, avg(v) - 1e-12 * avg(u) AS bf FROM {name}_g{tag} GROUP BY {cols}, alpha)""",
            f"""{name}_c{tag} AS (SELECT {cols}, alpha, a0 AS a, b0 AS b FROM {name}_f{tag} WHERE {ok}
              UNION ALL SELECT {cols}, alpha, greatest(al, 1e-12), 0.0 FROM {name}_f{tag} WHERE NOT ({ok})
              UNION ALL SELECT {cols}, alpha, greatest(au, 1e-12), bu FROM {name}_f{tag} WHERE NOT ({ok})
              UNION ALL SELECT {cols}, alpha, 1e-12, least(greatest(bf, 0), bu) FROM {name}_f{tag} WHERE NOT ({ok}))""",
            f"{name}_a{tag} AS (SELECT {cols}, alpha, a, b, sum(pow(v - a * u - b, 2)) AS sse, sum(pow(v - ym, 2)) AS sst, count(*) AS n FROM {name}_g{tag} JOIN {name}_c{tag} USING ({cols}, alpha) GROUP BY ALL)",
            f"{name}_s{tag} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {cols}, alpha ORDER BY sse, a, b) AS k1 FROM {name}_a{tag}) WHERE k1 = 1)",
        ]

    out = [
        f"{name}_p AS (SELECT {keys}, s::DOUBLE AS s, v, greatest(bu, 1e-9) AS bu, avg(v) OVER w AS ym, count(*) OVER w AS n FROM {points} WHERE s > 0 AND v > 0 WINDOW w AS (PARTITION BY {keys}))",
        *tried("1", f"{name}_p, (SELECT {lo}::DOUBLE + unnest(range(0, {grid + 1})) * 0.005::DOUBLE AS alpha)", keys),
        f"{name}_b1 AS (SELECT {keys}, alpha FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY round(sse / sst, 12), alpha) AS r FROM {name}_s1) WHERE r = 1)",
    ]
    for i, h in ((2, "0.005"), (3, "0.001"), (4, "0.0001")):
        spots = f"(SELECT {keys}, alpha AS centre, h, k, alpha + k * h AS alpha FROM (SELECT *, greatest(least({h}::DOUBLE, alpha - {lo}, {hi} - alpha), 0) AS h FROM {name}_b{i - 1}), (VALUES (-1), (0), (1)) AS w(k))"
        out += tried(str(i), f"{name}_p JOIN {spots} USING ({keys})", f"{keys}, centre, h, k")
        out += [
            f"{name}_t{i} AS (SELECT {keys}, centre, h, max(sse) FILTER (k = -1) AS l, max(sse) FILTER (k = 0) AS m, max(sse) FILTER (k = 1) AS r FROM {name}_s{i} GROUP BY ALL)",
            f"{name}_b{i} AS (SELECT {keys}, centre + CASE WHEN h > 1e-9 AND l - 2 * m + r > 0 THEN greatest(-h, least(h, h * (l - r) / (2 * (l - 2 * m + r)))) ELSE 0 END AS alpha FROM {name}_t{i})",
        ]
    out += tried("5", f"{name}_p JOIN {name}_b4 USING ({keys})", keys)
    out.append(f"{name} AS (SELECT {keys}, n::BIGINT AS n_points, a, alpha, b, sse, sqrt(sse / n) AS rmse, 1 - sse / sst AS r2 FROM {name}_s5)")
    return ",\n".join(out)


def optimum_sql(name: str, fits: str, keys: str) -> str:
    """First integer s with the least fitted objective; fits has a, alpha, b, n_eff."""
    return f"""{name} AS (SELECT {keys}, q AS fitted_s_star, o AS fitted_objective FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY o, q) AS r FROM (
      SELECT {keys}, q::DOUBLE AS q, (a * pow(q, -alpha) + b) / (n_eff - q) AS o FROM (SELECT *, unnest(range(1, n_eff)) AS q FROM {fits}))) WHERE r = 1)"""


_FIT = ["a", "alpha", "b", "sse", "rmse", "r2"]
_K = "method, replication"


@query("power_law_fit", sql_shaped("SELECT * FROM fit", ["method", "replication", "n_points"], _FIT, 5, with_=f"WITH {PILOT},\n{fit_sql('fit', 'pts', _K)}"))
def power_law_fit(spark, sf):
    fits = L.power_law_fit(fit_points(pilot_curve(spark, sf)), ["method", "replication"])
    return shaped(fits, ["method", "replication", "n_points"], _FIT, 5)


_OPT = f"{fit_sql('fit', 'pts', _K)},\nfitn AS (SELECT *, 1000 AS n_eff FROM fit),\n{optimum_sql('opt', 'fitn', _K)}"


@query("fitted_optimum", sql_shaped("SELECT * FROM opt", ["method", "replication"], ["fitted_s_star", "fitted_objective"], with_=f"WITH {PILOT},\n{_OPT}"))
def fitted_optimum(spark, sf):
    fits = L.power_law_fit(fit_points(pilot_curve(spark, sf)), ["method", "replication"]).withColumn("n_eff", F.lit(1000).cast("long"))
    return shaped(L.fitted_optimum(fits, ["method", "replication"]), ["method", "replication"], ["fitted_s_star", "fitted_objective"])


_SF = [*_FIT, "fitted_s_star", "fitted_objective", "empirical_oracle_objective"]
_EMP = f"emp AS (SELECT {_K}, s AS empirical_oracle_s, v / (n_eff - s) AS empirical_oracle_objective FROM (SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY v / (n_eff - s), s) AS r FROM pts) WHERE r = 1)"


@query(
    "scaling_fits",
    sql_shaped(f"SELECT * FROM fit JOIN opt USING ({_K}) JOIN emp USING ({_K})", ["method", "replication", "n_points", "empirical_oracle_s"], _SF, 5, with_=f"WITH {PILOT},\n{_OPT},\n{_EMP}"),
)
def scaling_fits(spark, sf):
    out = L.scaling_fits(fit_points(pilot_curve(spark, sf)), ["method", "replication"])
    return shaped(out, ["method", "replication", "n_points", "empirical_oracle_s"], _SF, 5)


MEAN_FIT = f"mpts AS (SELECT method, s, avg(v) AS v, max(bu) AS bu FROM pts GROUP BY ALL),\n{fit_sql('mfit', 'mpts', 'method')}"


def mean_fits(spark, sf):
    return L.fit_by_method(fit_points(pilot_curve(spark, sf)), ["method"])


@query("fit_by_method", sql_shaped("SELECT * FROM mfit", ["method", "n_points"], _FIT, 5, with_=f"WITH {PILOT},\n{MEAN_FIT}"))
def fit_by_method(spark, sf):
    return shaped(mean_fits(spark, sf), ["method", "n_points"], _FIT, 5)


@query(
    "holdout_prediction_error",
    sql_shaped(
        f"SELECT {_K}, quantile_cont(abs(a * pow(p.s, -alpha) + b - v) / v, 0.5) AS median_relative_error, count(*)::BIGINT AS n_points FROM pts p JOIN (SELECT {_K}, a, alpha, b FROM early) USING ({_K}) WHERE p.s > 400 GROUP BY ALL",
        ["method", "replication", "n_points"],
        ["median_relative_error"],
        5,
        with_=f"WITH {PILOT},\nearly_pts AS (SELECT * FROM pts WHERE s <= 400),\n{fit_sql('early', 'early_pts', _K)}",
    ),
)
def holdout_prediction_error(spark, sf):
    out = L.holdout_error(fit_points(pilot_curve(spark, sf)), ["method", "replication"], 400)
    return shaped(out, ["method", "replication", "n_points"], ["median_relative_error"], 5)


@query(
    "trim_replications",
    sql_shaped(
        f"SELECT method, replication, m FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY m, replication) AS lo, row_number() OVER (PARTITION BY method ORDER BY m DESC, replication DESC) AS hi FROM (SELECT {_K}, avg(v) AS m FROM pts GROUP BY ALL)) WHERE lo > 1 AND hi > 1",
        ["method", "replication"],
        ["m"],
        with_=f"WITH {PILOT}",
    ),
)
def trim_replications(spark, sf):
    means = fit_points(pilot_curve(spark, sf)).groupBy("method", "replication").agg(F.avg("value").alias("m"))
    return shaped(L.trim_replications(means, ["method"], "m"), ["method", "replication"], ["m"])


_RK = "method, replication, upto"
RAMP = f"""staged AS (SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY s) AS stage, count(*) OVER (PARTITION BY {_K}) AS stages, v / (n_eff - s) AS objective FROM pts),
prefix AS (SELECT a.method, a.replication, b.stage AS upto, a.s, a.v, a.bu, a.stages, b.s AS largest FROM staged a JOIN staged b ON a.method = b.method AND a.replication = b.replication AND a.stage <= b.stage AND b.stage >= 4),
{fit_sql('rfit', 'prefix', _RK)},
rfitn AS (SELECT r.*, 1000 AS n_eff, p.largest, p.stages FROM rfit r JOIN (SELECT DISTINCT {_RK}, largest, stages FROM prefix) p USING ({_RK})),
{optimum_sql('ropt', 'rfitn', _RK)},
halted AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY upto) AS r FROM rfitn JOIN ropt USING ({_RK}) WHERE upto = stages OR fitted_s_star <= largest) WHERE r = 1),
chosen AS (SELECT * FROM (SELECT h.*, s.s AS ramp_s, s.objective AS ramp_objective, (a * pow(s.s, -alpha) + b) / (1000 - s.s) AS ramp_fitted_objective,
  row_number() OVER (PARTITION BY h.method, h.replication ORDER BY (a * pow(s.s, -alpha) + b) / (1000 - s.s), s.s) AS pick
  FROM halted h JOIN staged s ON h.method = s.method AND h.replication = s.replication AND s.s <= h.largest) WHERE pick = 1),
{_EMP},
replay AS (SELECT {_K}, upto AS stopped_stage, largest AS stopped_largest_s, fitted_s_star AS ramp_fitted_s_star, ramp_s, ramp_fitted_objective, empirical_oracle_s AS oracle_s, ramp_objective,
  empirical_oracle_objective AS oracle_objective, (ramp_objective - empirical_oracle_objective) / empirical_oracle_objective AS regret, ramp_s = empirical_oracle_s AS exact_match, a AS fit_a, alpha AS fit_alpha, b AS fit_b, r2 AS fit_r2
  FROM chosen JOIN emp USING ({_K}))"""
_RC = ["ramp_fitted_s_star", "ramp_fitted_objective", "ramp_objective", "oracle_objective", "regret", "fit_a", "fit_alpha", "fit_b", "fit_r2"]
_RKEYS = ["method", "replication", "stopped_stage", "stopped_largest_s", "ramp_s", "oracle_s", "exact_match"]


def replay(spark, sf):
    return L.rampup_replay(fit_points(pilot_curve(spark, sf)), ["method", "replication"])


@query("rampup_replay", sql_shaped("SELECT * FROM replay", _RKEYS, _RC, 5, with_=f"WITH {PILOT},\n{RAMP}"))
def rampup_replay(spark, sf):
    return shaped(replay(spark, sf), _RKEYS, _RC, 5)


_RS = ["mean_regret", "median_regret", "sd_regret", "min_regret", "max_regret", "exact_match_rate", "mean_ramp_s", "mean_oracle_s"]


@query(
    "rampup_summary",
    sql_shaped(
        "SELECT method, count(*)::BIGINT AS n_replications, avg(regret) AS mean_regret, quantile_cont(regret, 0.5) AS median_regret, stddev_samp(regret) AS sd_regret, min(regret) AS min_regret, max(regret) AS max_regret, avg(exact_match::INT) AS exact_match_rate, avg(ramp_s) AS mean_ramp_s, avg(oracle_s) AS mean_oracle_s FROM replay GROUP BY method",
        ["method", "n_replications"],
        _RS,
        with_=f"WITH {PILOT},\n{RAMP}",
    ),
)
def rampup_summary(spark, sf):
    return shaped(L.rampup_summary(replay(spark, sf), ["method"]), ["method", "n_replications"], _RS)


@query(
    "rampup_savings",
    sql_shaped(
        f"SELECT {_K}, count(*) FILTER (s <= stopped_largest_s)::BIGINT AS fits_used, count(*)::BIGINT AS fits_all, 1 - count(*) FILTER (s <= stopped_largest_s) / count(*) AS fit_count_saving, 1 - sum(s) FILTER (s <= stopped_largest_s) / sum(s) AS label_effort_saving FROM pts JOIN replay USING ({_K}) GROUP BY ALL",
        ["method", "replication", "fits_used", "fits_all"],
        ["fit_count_saving", "label_effort_saving"],
        with_=f"WITH {PILOT},\n{RAMP}",
    ),
)
def rampup_savings(spark, sf):
    curve = materialise(fit_points(pilot_curve(spark, sf)), "curve")
    out = L.rampup_savings(curve, L.rampup_replay(curve, ["method", "replication"]), ["method", "replication"])
    return shaped(out, ["method", "replication", "fits_used", "fits_all"], ["fit_count_saving", "label_effort_saving"])


@query(
    "discrete_objective",
    sql_shaped(f"SELECT {_K}, s, v / (n_eff - s) AS objective FROM pts", ["method", "replication", "s"], ["objective"], 8, with_=f"WITH {PILOT}"),
)
def discrete_objective(spark, sf):
    pts = fit_points(pilot_curve(spark, sf))
    return shaped(pts.withColumn("objective", A.discrete_objective(F.col("value"), F.col("s"), F.col("n_eff"))), ["method", "replication", "s"], ["objective"], 8)


@query(
    "loss_comparison",
    sql_shaped(
        """SELECT method AS loss, s, avg(v) AS value, NULL::DOUBLE AS value_relative_delta FROM pts GROUP BY ALL UNION ALL
        SELECT 'quantity_minus_lines', s, a.v - b.v, (a.v - b.v) / b.v FROM (SELECT s, avg(v) AS v FROM pts WHERE method = 'quantity' GROUP BY s) a JOIN (SELECT s, avg(v) AS v FROM pts WHERE method = 'lines' GROUP BY s) b USING (s)""",
        ["loss", "s"],
        ["value", "value_relative_delta"],
        with_=f"WITH {PILOT}",
    ),
)
def loss_comparison(spark, sf):
    cells = fit_points(pilot_curve(spark, sf)).withColumnRenamed("method", "loss")
    out = L.loss_comparison(cells, [("quantity", "lines")], ["value"], "value")
    return shaped(out, ["loss", "s"], ["value", "value_relative_delta"])


_BAND = ["mean", "sd", "se", "ci95_low", "ci95_high"]


@query(
    "curve_summary_t",
    sql_shaped(
        "SELECT method, s, count(v)::BIGINT AS n, avg(v) AS mean, stddev_samp(v) AS sd, stddev_samp(v) / sqrt(5) AS se, avg(v) - 2.776445105 * stddev_samp(v) / sqrt(5) AS ci95_low, avg(v) + 2.776445105 * stddev_samp(v) / sqrt(5) AS ci95_high FROM pts GROUP BY ALL",
        ["method", "s", "n"],
        _BAND,
        with_=f"WITH {PILOT}",
    ),
)
def curve_summary_t(spark, sf):
    return shaped(L.curve_summary_t(fit_points(pilot_curve(spark, sf)), ["method", "s"]), ["method", "s", "n"], _BAND)


_ZB = ["mean", "sd", "se", "ci_low", "ci_high", "scale_rmse_mean", "stop_mse_mean"]


@query(
    "curve_summary_z",
    sql_shaped(
        "SELECT method, s, count(*)::BIGINT AS replications, avg(scale_residual_var) AS mean, stddev_samp(scale_residual_var) AS sd, stddev_samp(scale_residual_var) / sqrt(5) AS se, avg(scale_residual_var) - 1.96 * stddev_samp(scale_residual_var) / sqrt(5) AS ci_low, avg(scale_residual_var) + 1.96 * stddev_samp(scale_residual_var) / sqrt(5) AS ci_high, avg(scale_rmse) AS scale_rmse_mean, avg(stop_mse) AS stop_mse_mean FROM curve GROUP BY ALL",
        ["method", "s", "replications"],
        _ZB,
        with_=f"WITH {PILOT}",
    ),
)
def curve_summary_z(spark, sf):
    out = L.curve_summary_z(pilot_curve(spark, sf), ["method", "s"], "scale_residual_var", ["scale_rmse", "stop_mse"])
    return shaped(out, ["method", "s", "replications"], _ZB)


@query(
    "constant_baseline_var",
    sql_shaped(f"WITH {S.CLEAN} SELECT var_samp(n_chars) AS baseline_var, count(*)::BIGINT AS n FROM clean", ["n"], ["baseline_var"], 2),
)
def constant_baseline_var(spark, sf):
    from ..operators.population import clean_population

    clean = clean_population(load(spark, sf, "documents"), "text", "n_chars", "doc_id")
    return shaped(L.constant_baseline_var(clean, "n_chars"), ["n"], ["baseline_var"], 2)


# --- corrected means ----------------------------------------------------------------

_DOC_BUDGETS = (30, 60)
_PPI = ["mu_hat_ppi", "ppi_var_est", "ppi_ci_low", "ppi_ci_high", "sample_mean", "sample_mean_var_est", "correction_residual_var", "unlabeled_prediction_var"]
_PKEYS = ["budget", "replication", "n_eff", "s_train", "correction_size", "unlabeled_size"]


def document_table(spark, sf):
    """One narrow row per distinct text: features, and y where there is a label."""
    pop = POP.document_population(load(spark, sf, "documents"), load(spark, sf, "labels"))
    return materialise(pop.select("id", "y", "x1", "x2"), "documents")


def document_members(spark, sf):
    """All distinct texts with features, and labelled draws of several budgets."""
    pop = document_table(spark, sf)
    return pop, X.allocation_split(pop.where(F.col("y").isNotNull()).select("id", "y", "x1", "x2"), "id", REPS, _DOC_BUDGETS, seed=73)


DOCS = S.CLEAN + f""",
dw AS (SELECT c.doc_id AS id, l.quality::DOUBLE AS y, {S.words('c.text')} AS w, c.text FROM clean c LEFT JOIN labels l ON c.doc_id = l.doc_id),
docs AS (SELECT id, y, ln(1 + len(w)) AS x1, {S.reading_ease('len(w)', S.sentence_runs('text'), S.syllable_total('w'))} / 100 AS x2 FROM dw),
dranked AS (SELECT budget, replication, id, y, x1, x2, round_even(0.2 * budget, 0)::BIGINT AS v, row_number() OVER (PARTITION BY budget, replication ORDER BY md5(concat_ws(':', 73, budget, replication, 'allocation', id)), id) AS rank
  FROM docs, (VALUES (30), (60)) AS b(budget), (SELECT unnest(range(5)) AS replication) WHERE y IS NOT NULL),
dmem AS (SELECT *, budget - v AS n_eff, CASE WHEN rank > v THEN rank - v END AS tr, round_even(0.3 * (budget - v), 0) AS s FROM dranked WHERE rank <= budget),
dfit AS {fit2('(SELECT * FROM dmem WHERE tr <= s)', 'y', 'x1', 'x2', 'budget, replication')},
dunl AS (SELECT budget, replication, count(*) AS nu, avg(b0 + ba * x1 + bb * x2) AS mf, var_samp(b0 + ba * x1 + bb * x2) AS vf FROM docs JOIN dfit ON NOT EXISTS (SELECT 1 FROM dmem m WHERE m.budget = dfit.budget AND m.replication = dfit.replication AND m.id = docs.id) GROUP BY ALL),
dcor AS (SELECT budget, replication, any_value(n_eff) AS n_eff, any_value(s)::BIGINT AS s_train, count(*) FILTER (tr > s) AS nc, avg(y - b0 - ba * x1 - bb * x2) FILTER (tr > s) AS mr, var_samp(y - b0 - ba * x1 - bb * x2) FILTER (tr > s) AS vr, avg(y) AS ym, var_samp(y) / count(*) AS yv
  FROM dmem JOIN dfit USING (budget, replication) GROUP BY ALL)"""


@query(
    "ppi_mean",
    sql_shaped(
        """SELECT budget::BIGINT AS budget, replication, n_eff, s_train, nc::BIGINT AS correction_size, nu::BIGINT AS unlabeled_size, mr + mf AS mu_hat_ppi, vr / nc + vf / nu AS ppi_var_est,
        mr + mf - 1.96 * sqrt(vr / nc + vf / nu) AS ppi_ci_low, mr + mf + 1.96 * sqrt(vr / nc + vf / nu) AS ppi_ci_high, ym AS sample_mean, yv AS sample_mean_var_est, vr AS correction_residual_var, vf AS unlabeled_prediction_var
        FROM dcor JOIN dunl USING (budget, replication)""",
        _PKEYS,
        _PPI,
        with_=f"WITH {DOCS}",
    ),
)
def ppi_mean(spark, sf):
    """Mean quality of all documents from few labels and a two-feature surrogate."""
    pop, members = document_members(spark, sf)
    cells = G.ppi_cells(pop, members, {"linear": ["x1", "x2"]}, "y", "id", [0.3], target_known=False, sizes={b: X.validation_size(b) for b in _DOC_BUDGETS})
    return shaped(cells, _PKEYS, _PPI)


def scored_orders(spark, sf):
    """Prediction table: target orders with a pilot-trained prediction and a role."""
    from ..operators import influence as I
    from ..operators.moments import moments_of

    df = materialise(orders_split(spark, sf).where(F.col("split") != "unused"), "orders")
    fit = I.fit_ols(moments_of(df.where(F.col("split") == "h_scale"), ["x1"], "y")[()], "x1", ["x1"], "y")
    target = df.where(F.col("split") == "target")
    members = X.allocation_split(target, "id", REPS[:2], (500,), seed=79).select("replication", "id", "role")
    rows = target.withColumn("replication", F.explode(F.array(*[F.lit(r).cast("long") for r in REPS[:2]])))
    return rows.join(members, ["replication", "id"], "left").withColumn("pred", I.predict(fit))


SCORED = S.ORD + """,
sfit AS (SELECT regr_slope(y, x1) AS b1, regr_intercept(y, x1) AS b0 FROM ord_split WHERE split = 'h_scale'),
scored AS (SELECT replication, id, y, x1, b0 + b1 * x1 AS pred, CASE WHEN rank <= 100 THEN 'validation' WHEN rank <= 500 THEN 'effective' END AS role FROM (
  SELECT *, row_number() OVER (PARTITION BY replication ORDER BY md5(concat_ws(':', 79, 500, replication, 'allocation', id)), id) AS rank
  FROM ord_split, (SELECT unnest(range(2)) AS replication) WHERE split = 'target'), sfit)"""
_PT = ["correction_residual_mean", "correction_residual_var", "unlabeled_prediction_mean", "unlabeled_prediction_var", "mu_hat_ppi", "ppi_var_est", "ppi_var_est_raw", "ppi_se", "ppi_ci_low", "ppi_ci_high", "sample_mean", "sample_mean_var_est", "sample_mean_ci_low", "sample_mean_ci_high", "target_mean", "error", "abs_error", "sample_mean_error"]
_PTK = ["replication", "correction_size", "unlabeled_size", "ppi_covered", "sample_mean_covered"]


@query(
    "ppi_from_predictions",
    sql_shaped(
        """SELECT *, correction_residual_mean + unlabeled_prediction_mean AS mu_hat_ppi, sqrt(ppi_var_est) AS ppi_se, 25 * ppi_var_est AS ppi_var_est_raw, correction_residual_mean + unlabeled_prediction_mean - 1.96 * sqrt(ppi_var_est) AS ppi_ci_low, correction_residual_mean + unlabeled_prediction_mean + 1.96 * sqrt(ppi_var_est) AS ppi_ci_high,
        sample_mean - 1.96 * sqrt(sample_mean_var_est) AS sample_mean_ci_low, sample_mean + 1.96 * sqrt(sample_mean_var_est) AS sample_mean_ci_high, correction_residual_mean + unlabeled_prediction_mean - target_mean AS error, abs(correction_residual_mean + unlabeled_prediction_mean - target_mean) AS abs_error, sample_mean - target_mean AS sample_mean_error,
        abs(correction_residual_mean + unlabeled_prediction_mean - target_mean) <= 1.96 * sqrt(ppi_var_est) AS ppi_covered, abs(sample_mean - target_mean) <= 1.96 * sqrt(sample_mean_var_est) AS sample_mean_covered FROM (
        SELECT replication, count(*) FILTER (role = 'effective')::BIGINT AS correction_size, count(*) FILTER (role IS NULL)::BIGINT AS unlabeled_size, avg(y - pred) FILTER (role = 'effective') AS correction_residual_mean, var_samp(y - pred) FILTER (role = 'effective') AS correction_residual_var,
        avg(pred) FILTER (role IS NULL) AS unlabeled_prediction_mean, var_samp(pred) FILTER (role IS NULL) AS unlabeled_prediction_var,
        var_samp(y - pred) FILTER (role = 'effective') / count(*) FILTER (role = 'effective') + var_samp(pred) FILTER (role IS NULL) / count(*) FILTER (role IS NULL) AS ppi_var_est,
        avg(y) FILTER (role IS NOT NULL) AS sample_mean, var_samp(y) FILTER (role IS NOT NULL) / count(*) FILTER (role IS NOT NULL) AS sample_mean_var_est, avg(y) AS target_mean FROM scored GROUP BY replication)""",
        _PTK,
        _PT,
        with_=f"WITH {SCORED}",
    ),
)
def ppi_from_predictions(spark, sf):
    out = P.ppi_mean(
        scored_orders(spark, sf), ["replication"], "y", "pred", F.col("role") == "effective", F.col("role").isNull(), F.col("role").isNotNull(), F.lit(True)
    )
    return shaped(out, _PTK, _PT)


@query(
    "sample_mean_estimate",
    sql_shaped("SELECT replication, count(y)::BIGINT AS n, avg(y) AS mean, var_samp(y) / count(y) AS var_est, avg(y) - 1.96 * sqrt(var_samp(y) / count(y)) AS ci_low, avg(y) + 1.96 * sqrt(var_samp(y) / count(y)) AS ci_high FROM scored WHERE role IS NOT NULL GROUP BY ALL", ["replication", "n"], ["mean", "var_est", "ci_low", "ci_high"], with_=f"WITH {SCORED}"),
)
def sample_mean_estimate(spark, sf):
    rows = scored_orders(spark, sf).where(F.col("role").isNotNull())
    return shaped(P.sample_mean_estimate(rows, ["replication"], "y"), ["replication", "n"], ["mean", "var_est", "ci_low", "ci_high"])


@query("target_mean", sql_shaped("SELECT count(*)::BIGINT AS n, avg(y) AS target_mean FROM ord_split WHERE split = 'target'", ["n"], ["target_mean"], with_=f"WITH {S.ORD}"))
def target_mean(spark, sf):
    df = orders_split(spark, sf)
    return shaped(P.target_mean(df, df.where(F.col("split") == "target"), "id", "y"), ["n"], ["target_mean"])


@query(
    "ppi_plus_plus",
    sql_shaped(
        """SELECT *, my + power * (mu - mf) AS mean, (vy - 2 * power * cov + power * power * vf) / n + power * power * vu / n_unlabeled AS var_est FROM (SELECT *, cov / ((1 + n / n_unlabeled) * vf) AS power FROM (
        SELECT replication, count(*) FILTER (role IS NOT NULL)::BIGINT AS n, count(*) FILTER (role IS NULL)::BIGINT AS n_unlabeled, avg(y) FILTER (role IS NOT NULL) AS my, avg(pred) FILTER (role IS NOT NULL) AS mf, avg(pred) FILTER (role IS NULL) AS mu,
        covar_samp(y, pred) FILTER (role IS NOT NULL) AS cov, var_samp(pred) FILTER (role IS NOT NULL) AS vf, var_samp(pred) FILTER (role IS NULL) AS vu, var_samp(y) FILTER (role IS NOT NULL) AS vy FROM scored GROUP BY ALL))""",
        ["replication", "n", "n_unlabeled"],
        ["power", "mean", "var_est"],
        with_=f"WITH {SCORED}",
    ),
)
def ppi_plus_plus(spark, sf):
    out = P.ppi_plus_plus(scored_orders(spark, sf), ["replication"], "y", "pred", F.col("role").isNotNull(), F.col("role").isNull())
    return shaped(out, ["replication", "n", "n_unlabeled"], ["power", "mean", "var_est"])


# --- the allocation grid -------------------------------------------------------------


def theory_table(spark, sf):
    """Pilot parameters of the first method against every budget."""
    fit = mean_fits(spark, sf).where(F.col("method") == "lines").select("a", "alpha", "b")
    rows = fit.withColumn("budget", F.explode(F.array(*[F.lit(b).cast("long") for b in BUDGETS])))
    rows = rows.withColumn("n_eff", F.col("budget") - X.validation_size_column(F.col("budget")))
    return A.theoretical_allocation(rows, RHOS)


def allocation_cells(spark, sf, theory_rows=None):
    rows = theory_table(spark, sf) if theory_rows is None else theory_rows
    theory = {("lines", int(r["budget"])): float(r["theory_rho"]) for r in rows.collect()}
    target = materialise(orders_split(spark, sf).where(F.col("split") == "target"), "target")
    members = X.allocation_split(target, "id", REPS, BUDGETS, seed=83)
    return G.ppi_cells(target, members, METHODS, "y", "id", RHOS, theory, sizes={b: X.validation_size(b) for b in BUDGETS})


THEORY = f"""{MEAN_FIT},
budgets AS (SELECT budget, round_even(0.2 * budget, 0)::BIGINT AS v, budget - round_even(0.2 * budget, 0)::BIGINT AS n_eff FROM (VALUES (300), (500), (700), (1000)) AS b(budget)),
rhos AS (SELECT unnest({list(RHOS)})::DOUBLE AS rho),
tin AS (SELECT budget, n_eff, a, alpha, b FROM budgets, mfit WHERE method = 'lines'),
{optimum_sql('topt', 'tin', 'budget')},
theory AS (SELECT budget, n_eff, a, alpha, b, fitted_s_star::BIGINT AS theory_s, fitted_s_star / n_eff AS theory_rho, fitted_objective AS theory_objective FROM topt JOIN tin USING (budget)),
gridcells AS (SELECT budget, v, n_eff, NULL AS solo, 'grid' AS allocation_source, rho, greatest(1, least(n_eff - 1, round_even(rho * n_eff, 0)::BIGINT)) AS s_train FROM budgets, rhos
  UNION ALL SELECT budget, v, n_eff, 'lines', 'theory_exact', theory_rho, theory_s FROM theory JOIN budgets USING (budget, n_eff) WHERE NOT EXISTS (SELECT 1 FROM rhos WHERE abs(rhos.rho - theory_rho) <= 1e-10))"""
CELLS = THEORY + f""",
tg AS (SELECT id, y, x1, x2 FROM ord_split WHERE split = 'target'),
{_long('tl', 'tg')},
aranked AS (SELECT budget, v, n_eff, replication, id, row_number() OVER (PARTITION BY budget, replication ORDER BY md5(concat_ws(':', 83, budget, replication, 'allocation', id)), id) AS rank FROM tg, budgets, (SELECT unnest(range(5)) AS replication)),
amem AS (SELECT *, CASE WHEN rank > v THEN rank - v END AS tr FROM aranked WHERE rank <= budget),
alab AS (SELECT budget, replication, avg(y) AS ym, var_samp(y) / count(*) AS yv FROM amem JOIN tg USING (id) GROUP BY ALL),
aunl AS (SELECT method, budget, replication, count(*) AS nu, avg(x) AS mx, var_samp(x) AS vx FROM aranked JOIN tl USING (id) WHERE rank > budget GROUP BY ALL),
atr AS (SELECT method, budget, replication, allocation_source, rho, s_train, CASE WHEN var_pop(x) = 0 THEN avg(y) * avg(x) / (1 + avg(x) * avg(x)) ELSE regr_slope(y, x) END AS b1, CASE WHEN var_pop(x) = 0 THEN avg(y) / (1 + avg(x) * avg(x)) ELSE regr_intercept(y, x) END AS b0 FROM amem JOIN gridcells USING (budget) JOIN tl USING (id) WHERE tr <= s_train AND (solo IS NULL OR solo = method) GROUP BY ALL),
ares AS (SELECT method, budget, any_value(v) AS validation_size, any_value(n_eff) AS n_eff, replication, allocation_source, rho, s_train, b0, b1, count(*) FILTER (tr > s_train) AS nc, avg(y - b0 - b1 * x) FILTER (tr > s_train) AS mr, var_samp(y - b0 - b1 * x) FILTER (tr > s_train) AS vr,
  var_samp(y - b0 - b1 * x) FILTER (tr IS NULL) AS validation_residual_var, sqrt(avg(pow(y - b0 - b1 * x, 2)) FILTER (tr IS NULL)) AS validation_rmse, corr(y, x) FILTER (tr IS NULL) * sign(any_value(b1)) AS validation_corr
  FROM atr JOIN amem USING (budget, replication) JOIN tl USING (id, method) GROUP BY ALL),
cells AS (SELECT method, budget::BIGINT AS budget, replication, rho, allocation_source, validation_size, n_eff, s_train, nc::BIGINT AS correction_size, nu::BIGINT AS unlabeled_size, vr AS correction_residual_var, b1 * b1 * vx AS unlabeled_prediction_var,
  mr + b0 + b1 * mx AS mu_hat_ppi, vr / nc + b1 * b1 * vx / nu AS ppi_var_est, t AS target_mean, mr + b0 + b1 * mx - t AS ppi_error, abs(mr + b0 + b1 * mx - t) <= 1.96 * sqrt(vr / nc + b1 * b1 * vx / nu) AS ppi_covered,
  ym AS sample_mean, yv AS sample_mean_var_est, ym - t AS sample_mean_error, abs(ym - t) <= 1.96 * sqrt(yv) AS sample_mean_covered, validation_residual_var, validation_rmse, validation_corr
  FROM ares JOIN aunl USING (method, budget, replication) JOIN alab USING (budget, replication), (SELECT avg(y) AS t FROM tg))"""
_CK = ["method", "budget", "replication", "allocation_source", "validation_size", "n_eff", "s_train", "correction_size", "unlabeled_size", "ppi_covered", "sample_mean_covered"]
_CV = ["rho", "correction_residual_var", "unlabeled_prediction_var", "mu_hat_ppi", "ppi_var_est", "ppi_error", "sample_mean", "sample_mean_var_est", "sample_mean_error", "target_mean", "validation_residual_var", "validation_rmse", "validation_corr"]
_WC = f"WITH {PILOT},\n{CELLS}"


@query("allocation_cells", sql_shaped("SELECT * FROM cells", _CK, _CV, with_=_WC))
def allocation_cells_query(spark, sf):
    return shaped(allocation_cells(spark, sf), _CK, _CV)


@query(
    "theoretical_allocation",
    sql_shaped(
        """SELECT budget::BIGINT AS budget, n_eff, theory_s, theory_rho, theory_objective, eval_s AS theory_eval_s, eval_rho AS theory_eval_rho FROM (
        SELECT t.*, r.rho AS eval_rho, greatest(1, least(n_eff - 1, round_even(r.rho * n_eff, 0)::BIGINT)) AS eval_s, row_number() OVER (PARTITION BY budget ORDER BY abs(greatest(1, least(n_eff - 1, round_even(r.rho * n_eff, 0)::BIGINT)) - theory_s), r.rho) AS k FROM theory t, rhos r) WHERE k = 1""",
        ["budget", "n_eff", "theory_s", "theory_eval_s"],
        ["theory_rho", "theory_objective", "theory_eval_rho"],
        8,
        with_=f"WITH {PILOT},\n{THEORY}",
    ),
)
def theoretical_allocation(spark, sf):
    return shaped(theory_table(spark, sf), ["budget", "n_eff", "theory_s", "theory_eval_s"], ["theory_rho", "theory_objective", "theory_eval_rho"], 8)


_BYRHO = """byrho AS (SELECT budget, method, allocation_source, rho, s_train, count(DISTINCT replication)::BIGINT AS n_replications, avg(ppi_var_est) AS mean_ppi_var_est, stddev_samp(ppi_var_est) / sqrt(count(*)) AS se_ppi_var_est, avg(mu_hat_ppi) AS mean_mu_hat_ppi, avg(target_mean) AS mean_target_mean, avg(sample_mean) AS mean_sample_mean,
  stddev_samp(mu_hat_ppi) AS sd_mu_hat_ppi, avg(ppi_error) AS mean_error, sqrt(avg(ppi_error * ppi_error)) AS rmse_error, avg(ppi_covered::INT) AS coverage, avg(sample_mean_var_est) AS mean_sample_var_est, avg(sample_mean_covered::INT) AS sample_mean_coverage,
  avg(mu_hat_ppi) - 1.96 * stddev_samp(mu_hat_ppi) / sqrt(count(*)) AS ci95_low_mu_hat_ppi, avg(mu_hat_ppi) + 1.96 * stddev_samp(mu_hat_ppi) / sqrt(count(*)) AS ci95_high_mu_hat_ppi, avg(ppi_var_est) / avg(sample_mean_var_est) AS var_ratio_to_sample_mean FROM cells GROUP BY ALL)"""
_BK = ["budget", "method", "allocation_source", "s_train", "n_replications"]
_BV = ["rho", "mean_ppi_var_est", "se_ppi_var_est", "mean_mu_hat_ppi", "mean_target_mean", "mean_sample_mean", "sd_mu_hat_ppi", "mean_error", "rmse_error", "coverage", "mean_sample_var_est", "sample_mean_coverage", "ci95_low_mu_hat_ppi", "ci95_high_mu_hat_ppi", "var_ratio_to_sample_mean"]


@query("by_rho_summary", sql_shaped("SELECT * FROM byrho", _BK, _BV, with_=f"{_WC},\n{_BYRHO}"))
def by_rho_summary(spark, sf):
    return shaped(A.by_rho_summary(allocation_cells(spark, sf)), _BK, _BV)


_OK = ["budget", "method", "theory_s", "oracle_candidate_set", "grid_best_s", "grid_best_source", "eval_source", "eval_s"]
_OV = ["theory_rho", "grid_best_rho", "eval_rho", "var_ratio", "regret", "coverage", "mean_error", "rmse_error", "mean_ppi_var_est", "mean_sample_var_est"]


@query(
    "oracle_allocation",
    sql_shaped(
        """SELECT b.budget, b.method, CASE WHEN b.method = 'lines' THEN t.theory_rho END AS theory_rho, CASE WHEN b.method = 'lines' THEN t.theory_s END AS theory_s, CASE WHEN b.method = 'lines' THEN 'grid+theory_exact' ELSE 'grid' END AS oracle_candidate_set,
        b.rho AS grid_best_rho, b.s_train AS grid_best_s, b.allocation_source AS grid_best_source, e.allocation_source AS eval_source, e.rho AS eval_rho, e.s_train AS eval_s, e.var_ratio_to_sample_mean AS var_ratio,
        CASE WHEN b.method = 'lines' THEN (e.mean_ppi_var_est - b.mean_ppi_var_est) / b.mean_ppi_var_est END AS regret, e.coverage, e.mean_error, e.rmse_error, e.mean_ppi_var_est, e.mean_sample_var_est
        FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY budget, method ORDER BY mean_ppi_var_est, rho) AS k FROM byrho WHERE allocation_source = 'grid' OR method = 'lines') WHERE k = 1) b
        JOIN theory t ON t.budget = b.budget JOIN byrho e ON e.budget = b.budget AND e.method = b.method AND abs(e.rho - CASE WHEN b.method = 'lines' THEN t.theory_rho ELSE b.rho END) <= 1e-10""",
        _OK,
        _OV,
        with_=f"{_WC},\n{_BYRHO}",
    ),
)
def oracle_allocation(spark, sf):
    theory = materialise(theory_table(spark, sf), "theory")
    summary = A.by_rho_summary(allocation_cells(spark, sf, theory))
    return shaped(A.oracle_allocation(summary, theory, "lines"), _OK, _OV)


@query(
    "sample_savings",
    sql_shaped("SELECT budget, method, rho, count(*)::BIGINT AS n_replications, 1 - avg(ppi_var_est) / avg(sample_mean_var_est) AS var_reduction, avg(1 - ppi_var_est / sample_mean_var_est) AS mean_paired_reduction, stddev_samp(1 - ppi_var_est / sample_mean_var_est) / sqrt(count(*)) AS paired_se FROM cells GROUP BY ALL", ["budget", "method", "n_replications"], ["rho", "var_reduction", "mean_paired_reduction", "paired_se"], with_=_WC),
)
def sample_savings(spark, sf):
    return shaped(A.sample_savings(allocation_cells(spark, sf)), ["budget", "method", "n_replications"], ["rho", "var_reduction", "mean_paired_reduction", "paired_se"])


_AV = ["rmse", "rmse_se", "mae", "mae_se", "coverage", "coverage_se"]
_BOOT = """SELECT draw, budget, method, s_train, sqrt(avg(ppi_error * ppi_error)) AS rmse FROM cells JOIN (
          SELECT draw, ('0x' || substr(md5(concat_ws(':', 89, draw, slot)), 1, 15))::BIGINT % 5 AS replication FROM (SELECT unnest(range(200)) AS draw), (SELECT unnest(range(1, 6)) AS slot)) USING (replication)
        GROUP BY ALL"""


@query(
    "estimator_accuracy",
    sql_shaped("SELECT budget, method, s_train, count(*)::BIGINT AS n_replications, sqrt(avg(ppi_error * ppi_error)) AS rmse, avg(abs(ppi_error)) AS mae, stddev_samp(abs(ppi_error)) / sqrt(count(*)) AS mae_se, avg(ppi_covered::INT) AS coverage, stddev_samp(ppi_covered::INT) / sqrt(count(*)) AS coverage_se, any_value(b.rmse_se) AS rmse_se FROM cells JOIN (SELECT budget, method, s_train, stddev_samp(rmse) AS rmse_se FROM (" + _BOOT + ") GROUP BY ALL) AS b USING (budget, method, s_train) GROUP BY ALL", ["budget", "method", "s_train", "n_replications"], _AV, with_=_WC),
)
def estimator_accuracy(spark, sf):
    return shaped(A.estimator_accuracy(allocation_cells(spark, sf), ["budget", "method", "s_train"], replications=REPS, draws=200, seed=89), ["budget", "method", "s_train", "n_replications"], _AV)


@query(
    "bootstrap_ci",
    sql_shaped(
        """SELECT budget, method, s_train, quantile_cont(rmse, 0.025) AS ci_low, quantile_cont(rmse, 0.975) AS ci_high, stddev_samp(rmse) AS se, count(*)::BIGINT AS draws FROM (
        """ + _BOOT + ") GROUP BY ALL",
        ["budget", "method", "s_train", "draws"],
        ["ci_low", "ci_high", "se"],
        with_=_WC,
    ),
)
def bootstrap_ci(spark, sf):
    drawn = A.bootstrap(allocation_cells(spark, sf), ["budget", "method"], "replication", REPS, 200, seed=89)
    rmse = drawn.groupBy("draw", "budget", "method", "s_train").agg(F.sqrt(F.avg(F.col("ppi_error") * F.col("ppi_error"))).alias("rmse"))
    out = A.percentile_interval(rmse, ["budget", "method", "s_train"], "rmse")
    return shaped(out, ["budget", "method", "s_train", "draws"], ["ci_low", "ci_high", "se"])


_NESTED = {
    "ppi": ["target_mean", "mu_hat_ppi", "ppi_error", "correction_residual_var", "unlabeled_prediction_var", "ppi_var_est", "ppi_covered", "sample_mean", "sample_mean_var_est", "sample_mean_error", "sample_mean_covered"],
    "validation": ["validation_residual_var", "validation_rmse", "validation_corr"],
}


@query("write_metrics_json", sql_shaped("SELECT *, CASE WHEN allocation_source = 'grid' THEN 0.0 ELSE 0.0 END AS runtime_seconds FROM cells", [*_CK], [*_CV, "runtime_seconds"], with_=_WC))
def write_metrics_json(spark, sf):
    path = scratch(spark, "cells")
    sinks.write_metrics_json(allocation_cells(spark, sf), path, _NESTED)
    return shaped(MT.read_cell_metrics(spark, path), _CK, [*_CV, "runtime_seconds"])


@query("read_cell_metrics", sql_shaped("SELECT method, allocation_source, count(*)::BIGINT AS n, avg(mu_hat_ppi) AS mu, avg(validation_rmse) AS rmse FROM cells GROUP BY ALL", ["method", "allocation_source", "n"], ["mu", "rmse"], with_=_WC))
def read_cell_metrics(spark, sf):
    path = scratch(spark, "cells")
    sinks.write_metrics_json(allocation_cells(spark, sf), path, _NESTED)
    got = MT.read_cell_metrics(spark, f"{path}/*.json")
    out = got.groupBy("method", "allocation_source").agg(F.count(F.lit(1)).alias("n"), F.avg("mu_hat_ppi").alias("mu"), F.avg("validation_rmse").alias("rmse"))
    return shaped(out, ["method", "allocation_source", "n"], ["mu", "rmse"])


# --- checkpoints ---------------------------------------------------------------------


@query(
    "select_checkpoint",
    sql_shaped(
        """WITH h AS (SELECT user_id AS cell, dense_rank() OVER (PARTITION BY user_id ORDER BY ts::DATE)::BIGINT AS epoch, value FROM events),
        e AS (SELECT cell, epoch, avg(value) AS metric FROM h GROUP BY ALL),
        b AS (SELECT *, min(metric) OVER (PARTITION BY cell ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM e),
        i AS (SELECT *, prev IS NULL OR metric < prev AS improved FROM b),
        l AS (SELECT *, max(CASE WHEN improved THEN epoch END) OVER (PARTITION BY cell ORDER BY epoch) AS last_best FROM i),
        st AS (SELECT cell, min(epoch) AS stop_epoch FROM l WHERE epoch >= 3 AND epoch - last_best >= 4 GROUP BY cell),
        r AS (SELECT l.*, coalesce(stop_epoch, (SELECT max(epoch) FROM e WHERE e.cell = l.cell)) AS stop, stop_epoch IS NOT NULL AS early_stopped FROM l LEFT JOIN st USING (cell))
        SELECT cell, stop AS epochs_trained, early_stopped, arg_min(epoch, metric) AS best_epoch, min(metric) AS best_metric FROM r WHERE epoch <= stop GROUP BY ALL""",
        ["cell", "epochs_trained", "early_stopped", "best_epoch"],
        ["best_metric"],
    ),
)
def select_checkpoint(spark, sf):
    from ..operators.checkpoints import select_checkpoint as select

    from pyspark.sql import Window as W

    # equal means may differ in their last bits by the order in which values are added: it is that of the events, whatever the partitions
    events = load(spark, sf, "events").select(F.col("user_id").alias("cell"), F.to_date("ts").alias("day"), "event_id", "value").where("cell is not null")
    so_far = W.partitionBy("cell", "day").orderBy("event_id", "value")
    summed = events.select("cell", "day", F.row_number().over(so_far).alias("n"), F.avg("value").over(so_far.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("mean"))
    daily = summed.groupBy("cell", "day").agg(F.max_by("mean", "n").alias("metric"))
    history = daily.withColumn("epoch", F.row_number().over(W.partitionBy("cell").orderBy(F.asc_nulls_last("day"))).cast("long"))
    out = select(history, ["cell"], "epoch", "metric", min_epochs=3, patience=4)
    return shaped(out, ["cell", "epochs_trained", "early_stopped", "best_epoch"], ["best_metric"])


@query(
    "crossppi_mean",
    sql_shaped(
        f"""WITH {DOCS}, lab AS (SELECT id, y, x1, ('0x' || substr(md5('97:fold:' || id), 1, 15))::BIGINT % 5 AS fold FROM docs WHERE y IS NOT NULL),
        cf AS (SELECT f.fold, regr_slope(y, x1) AS b1, regr_intercept(y, x1) AS b0 FROM lab, (SELECT unnest(range(5)) AS fold) f WHERE lab.fold <> f.fold GROUP BY f.fold),
        r AS (SELECT count(*) AS n, avg(y - b0 - b1 * x1) AS m, var_samp(y - b0 - b1 * x1) AS v FROM lab JOIN cf USING (fold)),
        u AS (SELECT count(*) AS nu, avg(a + b * x1) AS mf, var_samp(a + b * x1) AS vf FROM docs, (SELECT avg(b0) AS a, avg(b1) AS b FROM cf) WHERE y IS NULL)
        SELECT n::BIGINT AS n_labelled, nu::BIGINT AS n_unlabeled, m + mf AS mu_hat, v / n + vf / nu AS var_est FROM r, u""",
        ["n_labelled", "n_unlabeled"],
        ["mu_hat", "var_est"],
    ),
)
def crossppi_mean(spark, sf):
    from ..plans.crossfit import crossppi_mean as cross

    pop = document_table(spark, sf)
    return shaped(cross(pop, ["x1"], "y", "id", folds=5, seed=97), ["n_labelled", "n_unlabeled"], ["mu_hat", "var_est"])


_RE = ["power", "mu_hat", "var_est", "sample_mean", "sample_var_est"]


@query(
    "reppi_mean",
    sql_shaped(
        f"""WITH {DOCS}, lab AS (SELECT id, y, x1, x2, ('0x' || substr(md5('97:fold:' || id), 1, 15))::BIGINT % 2 AS fold FROM docs WHERE y IS NOT NULL),
        others AS (SELECT f.fold AS keep, y, x1, x2 FROM lab, (SELECT unnest(range(2)) AS fold) f WHERE lab.fold <> f.fold),
        cf AS {fit2("others", "y", "x2", "x1", "keep")},
        size AS (SELECT count(y) AS n, count(*) - count(y) AS nu, (count(*) - count(y)) / count(*) AS power FROM docs),
        r AS (SELECT avg(y - power * (b0 + ba * x2 + bb * x1)) AS m, var_samp(y - power * (b0 + ba * x2 + bb * x1)) AS v, avg(y) AS my, var_samp(y) AS vy FROM lab JOIN cf ON fold = keep, size),
        u AS (SELECT avg(power * (a + b * x2 + c * x1)) AS mf, var_samp(power * (a + b * x2 + c * x1)) AS vf FROM docs, size, (SELECT avg(b0) AS a, avg(ba) AS b, avg(bb) AS c FROM cf) WHERE y IS NULL)
        SELECT n::BIGINT AS n_labelled, nu::BIGINT AS n_unlabeled, power, m + mf AS mu_hat, v / n + vf / nu AS var_est, my AS sample_mean, vy / n AS sample_var_est FROM r, u, size""",
        ["n_labelled", "n_unlabeled"],
        _RE,
    ),
)
def reppi_mean(spark, sf):
    """Reading ease as a given prediction of quality, recalibrated with the word count in two folds."""
    from ..plans.crossfit import reppi_mean as recalibrated

    return shaped(recalibrated(document_table(spark, sf), "x2", ["x1"], "y", "id", folds=2, seed=97), ["n_labelled", "n_unlabeled"], _RE)
