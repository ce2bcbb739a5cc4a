"""Least squares, influence functions and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import influence as I
from ..operators import moments as G
from ..plans import populations as POP
from ..plans import preference as PREF
from ..plans import screening as PL
from ..session import materialise
from . import sqlparts as S
from .data import load
from .project_queries import orders_split, preference_frame
from .registry import query, rounded, shaped, sql_shaped


def lines(spark, sf):
    return load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.col("l_returnflag").alias("flag"),
        (F.col("l_extendedprice") / 10000).alias("y"),
        (F.col("l_quantity") / 10).alias("x1"),
        (F.col("l_discount") * 10).alias("x2"),
        (F.col("l_tax") * 10).alias("x3"),
    )


LINES = """lines AS (SELECT l_orderkey AS id, l_returnflag AS flag, l_extendedprice / 10000 AS y, l_quantity / 10 AS x1, l_discount * 10 AS x2, l_tax * 10 AS x3 FROM lineitem)"""


def documents(spark, sf):
    """Features of the labelled texts, computed once and kept as a narrow table."""
    return materialise(POP.labelled_documents(load(spark, sf, "documents"), load(spark, sf, "labels")), "features")


def fit1(base: str, y: str, x: str, by: str = "") -> str:
    """Closed form of one regressor, as a sub-select."""
    keys = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return f"(SELECT {keys}count(*) AS n, avg({y}) AS my, avg({x}) AS mx, var_pop({x}) AS vx, covar_pop({x}, {y}) AS cxy FROM {base}{group})"


def fit2(base: str, y: str, a: str, b: str, by: str = "") -> str:
    """Closed form of two regressors."""
    keys = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return f"""(SELECT *, (vb * cay - cab * cby) / det AS ba, (va * cby - cab * cay) / det AS bb,
      my - (vb * cay - cab * cby) / det * ma - (va * cby - cab * cay) / det * mb AS b0 FROM (
      SELECT *, va * vb - cab * cab AS det FROM (
      SELECT {keys}count(*) AS n, avg({y}) AS my, avg({a}) AS ma, avg({b}) AS mb, var_pop({a}) AS va, var_pop({b}) AS vb,
        covar_pop({a}, {b}) AS cab, covar_pop({a}, {y}) AS cay, covar_pop({b}, {y}) AS cby FROM {base}{group})))"""


# weight of the first and of the second regressor in a two-regressor fit
WA = "((vb * ({a} - ma) - cab * ({b} - mb)) / det)"
WB = "((va * ({b} - mb) - cab * ({a} - ma)) / det)"


def influence_rows(base: str, y: str, target: str, controls=()) -> str:
    """SELECT with weight ``a``, residual ``r`` and coefficient ``beta`` of a fit on any number of columns.

    Columns are made orthogonal one after another, the target last; a column
    without spread has weight and coefficient zero.
    """
    share = "coalesce(sum(e{i} * {x}) OVER () / nullif(sum(e{i} * e{i}) OVER (), 0), 0) * e{i}"
    rows, xs = base, [*controls, target]
    for j, x in enumerate([*xs, y]):
        rest = "".join(" - " + share.format(i=i, x=x) for i in range(j))
        rows = f"(SELECT *, {x} - avg({x}) OVER (){rest} AS {'r' if j == len(xs) else f'e{j}'} FROM {rows})"
    last = f"e{len(xs) - 1}"
    rows = f"(SELECT *, coalesce({last} / nullif(avg({last} * {last}) OVER (), 0), 0) AS a FROM {rows})"
    return f"SELECT *, avg(a * {y}) OVER () AS beta FROM {rows}"


@query(
    "gram",
    sql_shaped(
        f"WITH {LINES} SELECT flag, count(*)::BIGINT AS n, avg(x1) AS m_x1, avg(x1 * x1) AS m_x1x1, avg(x1 * x2) AS m_x1x2, avg(x1 * x3) AS m_x1x3, avg(x2 * y) AS m_x2y, avg(y * y) AS m_yy FROM lines GROUP BY flag",
        ["flag", "n"],
        ["m_x1", "m_x1x1", "m_x1x2", "m_x1x3", "m_x2y", "m_yy"],
    ),
)
def gram(spark, sf):
    g = G.gram(lines(spark, sf), ["x1", "x2", "x3"], "y", by=["flag"])
    # place of each product in the upper triangle of (1, x1, x2, x3, y)
    place = {"m_x1": 1, "m_x1x1": 5, "m_x1x2": 6, "m_x1x3": 7, "m_x2y": 11, "m_yy": 14}
    return shaped(g.select("flag", "n", *[(F.col("zz")[i] / F.col("n")).alias(c) for c, i in place.items()]), ["flag", "n"], list(place))


@query(
    "gram_vectors",
    sql_shaped(
        """SELECT label::BIGINT AS label, count(*)::BIGINT AS n, avg(embedding[1]::DOUBLE) AS m_1, avg(embedding[1]::DOUBLE * embedding[64]::DOUBLE) AS m_1_64, avg(embedding[64]::DOUBLE * embedding[64]::DOUBLE) AS m_64_64 FROM embeddings GROUP BY label""",
        ["label", "n"],
        ["m_1", "m_1_64", "m_64_64"],
    ),
)
def gram_vectors(spark, sf):
    e = load(spark, sf, "embeddings").select(
        F.col("label").cast("long").alias("label"),
        F.concat(F.array(F.lit(1.0)), F.transform("embedding", lambda v: v.cast("double"))).alias("z"),
        F.lit(1.0).alias("w"),
    )
    g = G.gram_vectors(e, 65, ["label"])
    return shaped(
        g.select("label", "n", (F.col("zz")[1] / F.col("n")).alias("m_1"), (F.col("zz")[65 + 63] / F.col("n")).alias("m_1_64"), (F.element_at("zz", -1) / F.col("n")).alias("m_64_64")),
        ["label", "n"],
        ["m_1", "m_1_64", "m_64_64"],
    )


@query(
    "ols",
    sql_shaped(
        f"""WITH {LINES}, f AS {fit2('lines', 'y', 'x1', 'x2', 'flag')} SELECT flag, any_value(n)::BIGINT AS n, any_value(b0) AS b0, any_value(ba) AS b1, any_value(bb) AS b2, var_samp(y - b0 - ba * x1 - bb * x2) AS residual_var
        FROM lines JOIN f USING (flag) GROUP BY flag""",
        ["flag", "n"],
        ["b0", "b1", "b2", "residual_var"],
    ),
)
def ols(spark, sf):
    df = lines(spark, sf)
    fits = {k[0]: I.fit_ols(m, "x1", ["x1", "x2"], "y") for k, m in G.moments_of(df, ["x1", "x2"], "y", ["flag"]).items()}
    coef = spark.createDataFrame([(k, *[float(b) for b in f.beta]) for k, f in fits.items()], "flag string, b0 double, b1 double, b2 double")
    scored = df.join(F.broadcast(coef), "flag")
    r = F.col("y") - F.col("b0") - F.col("b1") * F.col("x1") - F.col("b2") * F.col("x2")
    out = scored.groupBy("flag", "b0", "b1", "b2").agg(F.count(F.lit(1)).alias("n"), F.var_samp(r).alias("residual_var"))
    return shaped(out, ["flag", "n"], ["b0", "b1", "b2", "residual_var"])


_LAM = 0.05


def _hess_sql() -> str:
    """2 x 2 Hessian [[1, m], [m, q]] with the four ridge rules."""
    parts = []
    for name, rule in I.RIDGE_RULES.items():
        a = f"(1 + {_LAM})" if rule.penalize_intercept else "1"
        c = f"(q + {_LAM})"
        det = f"({a} * {c} - m * m)"
        beta = f"(-m * my + {a} * mxy) / {det}" if rule.ridge_beta else "(mxy - m * my) / (q - m * m)"
        ca, cc = (a, c) if rule.condition_of == "ridged" else ("1", "q")
        root = f"sqrt(({ca} - {cc}) * ({ca} - {cc}) + 4 * m * m)"
        parts.append(
            f"SELECT '{name}' AS family, {beta} AS beta, -m / {det} AS inv_0, {a} / {det} AS inv_1, ({ca} + {cc} + {root}) / ({ca} + {cc} - {root}) AS condition FROM s"
        )
    return f"WITH {LINES}, s AS (SELECT avg(x2) AS m, avg(x2 * x2) AS q, avg(y) AS my, avg(x2 * y) AS mxy FROM lines)\n" + " UNION ALL ".join(parts)


@query("hessian_ridge", sql_shaped(_hess_sql(), ["family"], ["beta", "inv_0", "inv_1", "condition"]))
def hessian_ridge(spark, sf):
    from dataclasses import replace

    m = G.moments_of(lines(spark, sf), ["x2"], "y")[()]
    rows = []
    for name, rule in I.RIDGE_RULES.items():
        f = I.fit_ols(m, "x2", ["x2"], "y", replace(rule, ridge=_LAM))
        rows.append((name, f.beta_target, float(f.weight_row[0]), float(f.weight_row[1]), f.condition))
    df = spark.createDataFrame(rows, "family string, beta double, inv_0 double, inv_1 double, condition double")
    return shaped(df, ["family"], ["beta", "inv_0", "inv_1", "condition"])


@query(
    "condition_number",
    sql_shaped(
        f"WITH {LINES}, s AS (SELECT flag, avg(x1) AS m, avg(x1 * x1) AS q FROM lines GROUP BY flag) SELECT flag, (1 + q + sqrt((1 - q) * (1 - q) + 4 * m * m)) / (1 + q - sqrt((1 - q) * (1 - q) + 4 * m * m)) AS hessian_condition FROM s",
        ["flag"],
        ["hessian_condition"],
    ),
)
def condition_number(spark, sf):
    ms = G.moments_of(lines(spark, sf), ["x1"], "y", ["flag"])
    rows = [(k[0], I.fit_ols(m, "x1", ["x1"], "y").condition) for k, m in ms.items()]
    return shaped(spark.createDataFrame(rows, "flag string, hessian_condition double"), ["flag"], ["hessian_condition"])


@query(
    "if_weight",
    sql_shaped(f"WITH {S.POP}, f AS {fit2('pop', 'y', 'x1', 'x2')} SELECT id, {WB.format(a='x1', b='x2')} AS a FROM pop, f", ["id"], ["a"]),
)
def if_weight(spark, sf):
    df = documents(spark, sf)
    fit = I.fit_ols(G.moments_of(df, ["x1", "x2"], "y")[()], "x2", ["x1", "x2"], "y")
    return shaped(df.withColumn("a", I.if_weight(fit)), ["id"], ["a"])


@query(
    "cross_split_if_weight",
    sql_shaped(
        f"WITH {S.ORD}, f AS {fit2('(SELECT * FROM ord_split WHERE split = ' + chr(39) + 'target' + chr(39) + ')', 'y', 'x1', 'x2')} SELECT id, split, {WA.format(a='x1', b='x2')} AS a FROM ord_split, f",
        ["id", "split"],
        ["a"],
    ),
)
def cross_split_if_weight(spark, sf):
    df = orders_split(spark, sf)
    m = G.moments_of(df.where(F.col("split") == "target"), ["x1", "x2"], "y")[()]
    return shaped(df.withColumn("a", I.if_weight(I.fit_ols(m, "x1", ["x1", "x2"], "y"))), ["id", "split"], ["a"])


_IF = f"""WITH {LINES}, f AS {fit2('lines', 'y', 'x1', 'x2')}, r AS (SELECT flag, y, {WA.format(a='x1', b='x2')} AS a, y - b0 - ba * x1 - bb * x2 AS r FROM lines, f)"""


def weighted_lines(spark, sf):
    df = lines(spark, sf)
    fit = I.fit_ols(G.moments_of(df, ["x1", "x2"], "y")[()], "x1", ["x1", "x2"], "y")
    return df.withColumns({"a": I.if_weight(fit), "r": F.col("y") - I.predict(fit), "f": I.predict(fit)})


@query("ifvar", sql_shaped(f"{_IF} SELECT var_samp(a * r) AS ifvar_1, var_pop(a * r) AS ifvar_0, avg(a * r) AS ifmean, var_pop(a * y) AS zero_ifvar FROM r", [], ["ifvar_1", "ifvar_0", "ifmean", "zero_ifvar"]))
def ifvar(spark, sf):
    ar = F.col("a") * F.col("r")
    out = weighted_lines(spark, sf).agg(
        I.var(ar, 1).alias("ifvar_1"), I.var(ar, 0).alias("ifvar_0"), F.avg(ar).alias("ifmean"), F.var_pop(F.col("a") * F.col("y")).alias("zero_ifvar")
    )
    return shaped(out, [], ["ifvar_1", "ifvar_0", "ifmean", "zero_ifvar"])


_QS = ["if_weight_p50", "if_weight_p90", "if_weight_p95", "if_weight_p99", "if_weight_max"]


@query(
    "if_weight_quantiles",
    sql_shaped(f"{_IF} SELECT 'x1' AS fit, " + ", ".join(f"quantile_cont(abs(a), {q}) AS {c}" for q, c in zip((0.5, 0.9, 0.95, 0.99, 1.0), _QS)) + " FROM r", ["fit"], _QS),
)
def if_weight_quantiles(spark, sf):
    df = lines(spark, sf)
    fit = I.fit_ols(G.moments_of(df, ["x1", "x2"], "y")[()], "x1", ["x1", "x2"], "y")
    return shaped(I.influence_table(df, {"x1": fit}, "y", 1), ["fit"], _QS)


@query("ess_share", sql_shaped(f"{_IF} SELECT flag, pow(sum(a * a), 2) / sum(pow(a, 4)) / count(*) AS ess_share FROM r GROUP BY flag", ["flag"], ["ess_share"]))
def ess_share(spark, sf):
    out = weighted_lines(spark, sf).groupBy("flag").agg(I.ess_share(F.col("a")).alias("ess_share"))
    return shaped(out, ["flag"], ["ess_share"])


@query(
    "vif",
    sql_shaped(f"WITH {S.ORD} SELECT split, 1 / (1 - pow(corr(x1, x2), 2)) AS vif FROM ord_split GROUP BY split", ["split"], ["vif"]),
)
def vif(spark, sf):
    ms = G.moments_of(orders_split(spark, sf), ["x1", "x2"], "y", ["split"])
    rows = [(k[0], float(I.vif(m, "x1", ["x2"]))) for k, m in ms.items()]
    return shaped(spark.createDataFrame(rows, "split string, vif double"), ["split"], ["vif"])


_FAMILY = {"x1": "size", "x2": "size", "y": "value", "x1b": "copy"}


@query(
    "eligible_controls",
    f"""WITH {S.ORD}, x AS (SELECT y, x1, x2, x1 * 2 + 1 AS x1b FROM ord_split),
    p AS (SELECT 'x1' AS target, 'y' AS control, corr(x1, y) AS r FROM x UNION ALL SELECT 'x1', 'x1b', corr(x1, x1b) FROM x
      UNION ALL SELECT 'x2', 'y', corr(x2, y) FROM x UNION ALL SELECT 'x2', 'x1b', corr(x2, x1b) FROM x)
    SELECT target, control FROM p WHERE abs(r) < 0.85""",
)
def eligible_controls(spark, sf):
    df = orders_split(spark, sf).withColumn("x1b", F.col("x1") * 2 + 1)
    m = G.moments_of(df, ["y", "x1", "x2", "x1b"], None)[()]
    rows = [(t, c) for t in ("x1", "x2") for c in I.eligible_controls(m, t, ["x1", "x2", "y", "x1b"], _FAMILY)]
    return spark.createDataFrame(rows, "target string, control string")


@query(
    "max_abs_corr",
    sql_shaped(
        f"WITH {S.ORD} SELECT 'x1' AS feature, greatest(abs(corr(x1, x2)), abs(corr(x1, y))) AS max_abs_corr FROM ord_split UNION ALL SELECT 'x2', greatest(abs(corr(x2, x1)), abs(corr(x2, y))) FROM ord_split",
        ["feature"],
        ["max_abs_corr"],
    ),
)
def max_abs_corr(spark, sf):
    out = I.max_abs_corr_table(orders_split(spark, sf), ["x1", "x2"], ["x1", "x2", "y"])
    return shaped(out, ["feature"], ["max_abs_corr"])


_CC = ("x1", "x2", "x3", "y")


@query(
    "corr_matrix",
    sql_shaped(f"WITH {LINES} " + " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS corr FROM lines" for a in _CC for b in _CC), ["feature_a", "feature_b"], ["corr"]),
)
def corr_matrix(spark, sf):
    return shaped(I.corr_matrix(lines(spark, sf), _CC), ["feature_a", "feature_b"], ["corr"])


_PT = tuple(f"{d}_scale" for d in PREF.DELTAS)
_CS = ["beta", "intercept", "residual_var", "ifvar", "se_full_population", "ci95_half_width_full_population", "if_weight_p50", "if_weight_p90", "if_weight_p95", "if_weight_p99", "if_weight_max", "nonzero_share", "raw_mean", "raw_sd", "effect_of_doubling"]


def _coef_sql() -> str:
    parts = []
    q = ", ".join(f"quantile_cont(abs(a), {p}) AS {c}" for p, c in zip((0.5, 0.9, 0.95, 0.99, 1.0), _QS))
    for t in _PT:
        doubling = "any_value(beta) * ln(2.0)" if t.startswith("delta_log_length") else "NULL::DOUBLE"
        head = f"""any_value(beta) AS beta, avg(y) AS mean_y, var_pop(r) AS residual_var, var_pop(a * r) AS ifvar, sqrt(var_pop(a * r) / count(*)) AS se_full_population, 1.96 * sqrt(var_pop(a * r) / count(*)) AS ci95_half_width_full_population,
        {q}, avg((abs({t}) > 1e-12)::INT) AS nonzero_share, avg({t}) AS raw_mean, stddev_pop({t}) AS raw_sd, {doubling} AS effect_of_doubling"""
        for model, controls in (("marginal", ()), ("controlled", [o for o in _PT if o != t])):
            group = f"'{model}'" if model == "controlled" else f"'{t}'"
            parts.append(f"SELECT '{model}' AS model, '{t}' AS target, {group} AS fit, {head} FROM ({influence_rows('pref_frame', 'y', t, controls)})")
    # the intercept is the mean outcome less the coefficients at the means
    return f"WITH {S.PREF_DELTA}\nSELECT *, mean_y - sum(beta * raw_mean) OVER (PARTITION BY fit) AS intercept FROM (" + " UNION ALL ".join(parts) + ")"


@query("coef_summary", sql_shaped(_coef_sql(), ["model", "target"], _CS))
def coef_summary(spark, sf):
    out = PL.coef_summary(preference_frame(spark, sf), _PT, _PT, "y_preference_strength")
    return shaped(out, ["model", "target"], _CS)


@query(
    "ci_by_budget",
    sql_shaped(
        f"SELECT model, target, budget::BIGINT AS budget, sqrt(ifvar / budget) AS se_proxy, 1.96 * sqrt(ifvar / budget) AS ci95_half_width_proxy, 3.92 * sqrt(ifvar / budget) AS ci95_length_proxy FROM ({_coef_sql()}), (VALUES (500), (1000), (3000)) AS b(budget)",
        ["model", "target", "budget"],
        ["se_proxy", "ci95_half_width_proxy", "ci95_length_proxy"],
    ),
)
def ci_by_budget(spark, sf):
    rows = PL.coef_summary(preference_frame(spark, sf), _PT, _PT, "y_preference_strength")
    out = I.ci_by_budget(rows.select("model", "target", "ifvar"), "ifvar", (500, 1000, 3000))
    return shaped(out, ["model", "target", "budget"], ["se_proxy", "ci95_half_width_proxy", "ci95_length_proxy"])


def text_candidates(spark, sf):
    """Labelled documents, z-scored features, h_scale / target split."""
    from ..operators.scaling import zscore
    from ..operators.splits import population_split, sized_fraction

    df = documents(spark, sf).withColumns(
        {"raw_log_word_count": F.col("x1"), "raw_reading_ease": F.col("x2"), "raw_lang_en": (F.col("lang") == "en").cast("double")}
    )
    z = zscore(df, {f.replace("raw_", "feat_"): f for f in ("raw_log_word_count", "raw_reading_ease", "raw_lang_en")})
    n = sized_fraction(df, 1.0)
    return population_split(z, "id", n, sized_fraction(df, 0.4), seed=67)


CAND = S.POP + """,
cand_raw AS (SELECT id, y, x1 AS raw_log_word_count, x2 AS raw_reading_ease, (lang = 'en')::INT::DOUBLE AS raw_lang_en, count(*) OVER () AS n,
  row_number() OVER (ORDER BY md5('67:population:' || id), id) AS r FROM pop),
cand AS (SELECT id, y, CASE WHEN r <= round_even(0.4 * n, 0) THEN 'h_scale' ELSE 'target' END AS split, """ + ", ".join(
    f"{c}, ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c.replace('raw_', 'feat_')}" for c in ("raw_log_word_count", "raw_reading_ease", "raw_lang_en")
) + " FROM cand_raw)"
_CF = ("log_word_count", "reading_ease", "lang_en")
_CAND_COLS = ["nonzero_share", "raw_mean", "raw_sd", "raw_p05", "raw_p50", "raw_p95", "beta_scaled_y", "beta_raw_points", "beta_raw_unit_points", "abs_beta_raw_points", "direct_ifvar", "direct_residual_var", *_QS]


def _cand_sql() -> str:
    parts = []
    for f in _CF:
        x, raw = f"feat_{f}", f"raw_{f}"
        q = ", ".join(f"quantile_cont(abs(a), {p}) AS {c}" for p, c in zip((0.5, 0.9, 0.95, 0.99, 1.0), _QS))
        parts.append(
            f"""SELECT * FROM (SELECT 'feat_{f}' AS feature, avg((abs({raw}) > 1e-12)::INT) AS nonzero_share, avg({raw}) AS raw_mean, stddev_pop({raw}) AS raw_sd,
            quantile_cont({raw}, 0.05) AS raw_p05, quantile_cont({raw}, 0.5) AS raw_p50, quantile_cont({raw}, 0.95) AS raw_p95 FROM cand),
            (SELECT any_value(beta) AS beta_scaled_y, any_value(beta) * 5 AS beta_raw_points, any_value(beta) * 5 / (SELECT stddev_pop({raw}) FROM cand) AS beta_raw_unit_points,
             abs(any_value(beta) * 5) AS abs_beta_raw_points, var_samp(a * r) AS direct_ifvar, var_samp(r) AS direct_residual_var, {q} FROM (
             SELECT ({x} - mx) / vx AS a, y - my - cxy / vx * ({x} - mx) AS r, cxy / vx AS beta FROM cand, {fit1("(SELECT * FROM cand WHERE split = 'target')", 'y', x)} WHERE split = 'target'))"""
        )
    return " UNION ALL ".join(parts)


CAND_SQL = f"WITH {CAND}\nSELECT *, nonzero_share >= 0.03 AND if_weight_p99 <= 10 AS passes_stability FROM ({_cand_sql()})"


def candidates(spark, sf):
    return PL.candidate_summary(text_candidates(spark, sf), {f"feat_{f}": f"raw_{f}" for f in _CF}, "y")


@query("candidate_summary", sql_shaped(CAND_SQL, ["feature", "passes_stability"], _CAND_COLS))
def candidate_summary(spark, sf):
    return shaped(candidates(spark, sf), ["feature", "passes_stability"], _CAND_COLS)


SPEC_POOL = ("delta_x1", "delta_x2", "delta_x3")


def spec_rows(spark, sf):
    """Which columns may be a target: features of the line table that vary."""
    from ..operators.scaling import usable_features

    df = lines(spark, sf).select(*[F.col(c[6:]).alias(c) for c in SPEC_POOL])
    names = [r["feature"] for r in usable_features(df, SPEC_POOL).orderBy("position").collect()]
    return PL.spec_enumerate(spark, names[:2], names, ["delta_x1", "delta_x3"], [1, 2, 3])


_SPEC_SQL = """WITH u AS (SELECT * FROM (SELECT 0 AS i, 'x1' AS c, stddev_pop(l_quantity) AS sd FROM lineitem UNION ALL SELECT 1, 'x2', stddev_pop(l_discount) FROM lineitem UNION ALL SELECT 2, 'x3', stddev_pop(l_tax) FROM lineitem) WHERE sd > 1e-12),
t AS (SELECT c AS target FROM u WHERE i < 2)
SELECT target AS spec_id, 'delta_' || target AS target, '' AS controls, 1 AS dimension, 'target_only' AS family FROM t
UNION ALL SELECT target || '__' || a.c, 'delta_' || target, 'delta_' || a.c, 2, 'target_plus_1' FROM t JOIN u a ON a.c <> target
UNION ALL SELECT target || '__' || a.c || '__' || b.c, 'delta_' || target, 'delta_' || a.c || ',delta_' || b.c, 3, 'target_plus_2' FROM t JOIN u a ON a.c <> target JOIN u b ON b.c <> target AND a.i < b.i
UNION ALL SELECT target || '__' || string_agg(f, '__' ORDER BY f), 'delta_' || target, string_agg('delta_' || f, ',' ORDER BY f), (1 + count(*))::INT, 'final_controls' FROM t JOIN (VALUES ('x1'), ('x3')) AS v(f) ON f <> target GROUP BY target"""


@query("spec_enumerate", _SPEC_SQL)
def spec_enumerate(spark, sf):
    return spec_rows(spark, sf).withColumn("controls", F.array_join("controls", ","))


_SS = ["nonzero_share", "beta", "abs_beta", "ifvar", "if_weight_p50", "if_weight_p90", "if_weight_p95", "if_weight_p99", "if_weight_max", "direct_ci_halfwidth_B500"]


_SPEC_X = ("x1", "x2", "x3")
_FINAL = ("x1", "x3")  # the final controls


def _spec_summary_sql() -> str:
    listed = {}
    for t in _SPEC_X:
        others = [c for c in _SPEC_X if c != t]
        listed |= {(t, ()): "target_only", **{(t, (c,)): "target_plus_1" for c in others}, (t, tuple(others)): "target_plus_2"}
    wanted = [(t, cs, f) for (t, cs), f in listed.items()] + [(t, tuple(c for c in _FINAL if c != t), "final_controls") for t in _SPEC_X]
    q = ", ".join(f"quantile_cont(abs(a), {p}) AS {c}" for p, c in zip((0.5, 0.9, 0.95, 0.99, 1.0), _QS))
    tgt = "(SELECT * FROM spec_lines WHERE split = 'target')"
    parts = [
        f"SELECT '{'__'.join([t, *cs])}' AS spec_id, '{family}' AS family, {1 + len(cs)} AS dimension, (SELECT avg(({t} <> 0)::INT) FROM spec_lines) AS nonzero_share, any_value(beta) AS beta, abs(any_value(beta)) AS abs_beta, var_samp(a * r) AS ifvar, {q}, 1.96 * sqrt(var_samp(a * r) / 500) AS direct_ci_halfwidth_B500 FROM ({influence_rows(tgt, 'y', t, cs)})"
        for t, cs, family in wanted
    ]
    return f"WITH {LINES}, spec_lines AS (SELECT *, CASE WHEN flag = 'N' THEN 'h_scale' ELSE 'target' END AS split FROM lines)\n" + " UNION ALL ".join(parts)


def spec_frame(spark, sf):
    return lines(spark, sf).select(
        "y", *[F.col(c).alias(f"delta_{c}") for c in _SPEC_X], F.when(F.col("flag") == "N", "h_scale").otherwise("target").alias("split")
    )


@query("spec_summary", sql_shaped(_spec_summary_sql(), ["spec_id", "family", "dimension"], _SS))
def spec_summary(spark, sf):
    """Every feature as a target: alone, with one and with two of the others, and with the final controls."""
    names = [f"delta_{c}" for c in _SPEC_X]
    specs = PL.spec_enumerate(spark, names, names, [f"delta_{c}" for c in _FINAL], [1, 2, 3])
    return shaped(PL.spec_summary(spec_frame(spark, sf), specs, "y", [500]), ["spec_id", "family", "dimension"], _SS)


# feature: (family, raw column of lineitem, divisor, the controls left to it)
_DIAG = {
    "x1": ("size", "l_quantity", 10, ("x2", "x3")),  # x4 is too close to it
    "x2": ("rate", "l_discount", 0.1, ("x1", "x4")),  # x3 is of its family
    "x3": ("rate", "l_tax", 0.1, ("x1", "x4")),
    "x4": ("place", "l_quantity + l_linenumber", 10, ("x2", "x3")),
}
_DC = ["beta_controlled", "abs_beta_controlled", "nonzero_share", "sd_raw", "target_vif", "max_abs_corr_with_controls", "ols_ifvar", "zero_surrogate_ifvar", "tfidf_ifvar", "tfidf_ifvar_ratio_vs_zero",
       "tfidf_ifvar_ratio_vs_ols", *[f"{c}_abs" for c in _QS], "if_ess_share", "direct_ci_halfwidth_B500"]


def _diag_sql() -> str:
    rows = ", ".join(f"({raw})::DOUBLE AS {f}_raw, ({raw})::DOUBLE / {by} AS {f}" for f, (_, raw, by, _) in _DIAG.items())
    q = ", ".join(f"quantile_cont(abs(a), {p}) AS {c}_abs" for p, c in zip((0.5, 0.9, 0.95, 0.99, 1.0), _QS))
    parts = []
    for f, (family, _, _, controls) in _DIAG.items():
        near = ", ".join(f"abs(corr({f}, {c}))" for c in controls)
        parts.append(
            f"""SELECT '{f}' AS feature, '{family}' AS family, '{','.join(controls)}' AS controls, count(DISTINCT {f}_raw)::BIGINT AS unique_values, any_value(beta) AS beta_controlled, abs(any_value(beta)) AS abs_beta_controlled,
            avg((abs({f}_raw) > 1e-12)::INT) AS nonzero_share, stddev_pop({f}_raw) AS sd_raw, var_pop({f}) / avg(e{len(controls)} * e{len(controls)}) AS target_vif, greatest({near}) AS max_abs_corr_with_controls,
            var_pop(a * r) AS ols_ifvar, var_pop(a * y) AS zero_surrogate_ifvar, var_pop(a * (y - pred)) AS tfidf_ifvar, var_pop(a * (y - pred)) / var_pop(a * y) AS tfidf_ifvar_ratio_vs_zero, var_pop(a * (y - pred)) / var_pop(a * r) AS tfidf_ifvar_ratio_vs_ols,
            {q}, pow(sum(a * a), 2) / sum(pow(a, 4)) / count(*) AS if_ess_share, 1.96 * sqrt(var_pop(a * r) / 500) AS direct_ci_halfwidth_B500 FROM ({influence_rows('diag', 'y', f, controls)})"""
        )
    return f"WITH diag AS (SELECT l_extendedprice / 10000 AS y, l_quantity / 14 AS pred, {rows} FROM lineitem WHERE l_returnflag <> 'N')\n" + " UNION ALL ".join(parts)


@query("candidate_diagnostics_lines", sql_shaped(_diag_sql(), ["feature", "family", "controls", "unique_values"], _DC))
def candidate_diagnostics_lines(spark, sf):
    """The job of ``candidate_diagnostics`` over the line table, with controls left out by family and by closeness."""
    raw = {f"{f}_raw": F.expr(r).cast("double") for f, (_, r, _, _) in _DIAG.items()}
    df = load(spark, sf, "lineitem").select(
        (F.col("l_extendedprice") / 10000).alias("y"),
        (F.col("l_quantity") / 14).alias("pred"),
        F.when(F.col("l_returnflag") == "N", "h_scale").otherwise("target").alias("split"),
        *[c.alias(n) for n, c in raw.items()],
    )
    df = df.withColumns({f: F.col(f"{f}_raw") / by for f, (_, _, by, _) in _DIAG.items()})
    meta = spark.createDataFrame([(f, family, "continuous", 1) for f, (family, *_) in _DIAG.items()], "feature string, family string, kind string, priority int")
    out = PL.candidate_diagnostics(df, meta, list(_DIAG), "y", "pred", [500])
    return shaped(out, ["feature", "family", "controls", "unique_values"], _DC)


@query(
    "if_square_weights",
    sql_shaped(
        f"WITH {S.POP}, f AS {fit2('pop', 'y', 'x1', 'x2')}, a AS (SELECT id, pow({WA.format(a='x1', b='x2')}, 2) AS s FROM pop, f), c AS (SELECT id, least(s, (SELECT quantile_cont(s, 0.99) FROM a)) AS s FROM a) SELECT id, s / avg(s) OVER () AS w FROM c",
        ["id"],
        ["w"],
    ),
)
def if_square_weights(spark, sf):
    df = documents(spark, sf)
    fit = I.fit_ols(G.moments_of(df, ["x1", "x2"], "y")[()], "x1", ["x1", "x2"], "y")
    return shaped(I.if_square_weights(df.select("id", I.if_weight(fit).alias("a")), "a"), ["id"], ["w"])


@query("clip_if_weight", sql_shaped(f"WITH {S.POP}, f AS {fit2('pop', 'y', 'x1', 'x2')} SELECT id, greatest(-0.8, least(0.8, {WA.format(a='x1', b='x2')})) AS a FROM pop, f", ["id"], ["a"]))
def clip_if_weight(spark, sf):
    df = documents(spark, sf)
    fit = I.fit_ols(G.moments_of(df, ["x1", "x2"], "y")[()], "x1", ["x1", "x2"], "y")
    return shaped(df.withColumn("a", I.clip_if_weight(I.if_weight(fit), 0.8)), ["id"], ["a"])


_PM = ["residual_mean_scaled", "residual_var_scaled", "residual_var_raw", "rmse_scaled", "rmse_raw", "prediction_var_scaled", "correlation"]


@query(
    "prediction_metrics",
    sql_shaped(
        f"""{_IF}, p AS (SELECT flag, y, y - r AS f, r FROM r) SELECT flag, count(*)::BIGINT AS n, avg(r) AS residual_mean_scaled, var_samp(r) AS residual_var_scaled, 25 * var_samp(r) AS residual_var_raw,
        sqrt(avg(r * r)) AS rmse_scaled, 5 * sqrt(avg(r * r)) AS rmse_raw, var_samp(f) AS prediction_var_scaled, corr(y, f) AS correlation FROM p GROUP BY flag""",
        ["flag", "n"],
        _PM,
    ),
)
def prediction_metrics(spark, sf):
    return shaped(I.prediction_metrics(weighted_lines(spark, sf), ["flag"], "y", "f"), ["flag", "n"], _PM)


@query("evaluate_predictions", sql_shaped(f"{_IF} SELECT flag, avg(r * r) AS mse, var_pop(a * r) AS ifvar, avg(a * r) AS ifmean FROM r GROUP BY flag", ["flag"], ["mse", "ifvar", "ifmean"]))
def evaluate_predictions(spark, sf):
    return shaped(I.evaluate_predictions(weighted_lines(spark, sf), ["flag"], "y", "f", "a"), ["flag"], ["mse", "ifvar", "ifmean"])


_KINDS = ("var", "mse", "if_mse", "ifvar")


@query("residual_loss", sql_shaped(f"{_IF} SELECT flag, var_pop(r) AS var, avg(r * r) AS mse, avg(pow(a * r, 2)) AS if_mse, var_pop(a * r) AS ifvar FROM r GROUP BY flag", ["flag"], list(_KINDS)))
def residual_loss(spark, sf):
    out = weighted_lines(spark, sf).groupBy("flag").agg(*[I.residual_loss(k, F.col("r"), F.col("a")).alias(k) for k in _KINDS])
    return shaped(out, ["flag"], list(_KINDS))


@query("split_counts", sql_shaped(f"WITH {S.ORD} SELECT split, count(*)::BIGINT AS n, min(y) AS y_min, max(y) AS y_max, avg(y) AS y_mean FROM ord_split GROUP BY split", ["split", "n"], ["y_min", "y_max", "y_mean"]))
def split_counts(spark, sf):
    return shaped(I.split_counts(orders_split(spark, sf), "split", "y"), ["split", "n"], ["y_min", "y_max", "y_mean"])


@query(
    "preference_summary",
    f"WITH {S.PREF_DELTA} SELECT count(*)::BIGINT AS n_rows, min(y) AS y_min, max(y) AS y_max, round(avg(y), 6) AS y_mean, count(*) FILTER (split = 'train')::BIGINT AS n_train, count(*) FILTER (split = 'validation')::BIGINT AS n_validation FROM pref_delta",
)
def preference_summary(spark, sf):
    from ..plans.preference import preference_summary as summary

    out = summary(preference_frame(spark, sf))
    return out.select(
        "n_rows", "y_min", "y_max", rounded(F.col("y_mean")).alias("y_mean"), F.col("split_counts")["train"].alias("n_train"), F.col("split_counts")["validation"].alias("n_validation")
    )
