"""Power laws v(s) = a s^-alpha + b: fitting, optimum, ramp-up replay.

The fit is variable projection: for a fixed alpha the best (a, b) has a closed
form in five centred moments, so an alpha grid and a few parabola steps replace
an iterative solver, and all curves are fitted in one query.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Bounds of the exponent.
ALPHA_BOUNDS = (0.02, 1.5)
WIDE_ALPHA_BOUNDS = (0.01, 3.0)
A_MIN = 1e-12
STEP = 0.005  # alpha grid
HALF_WIDTHS = (0.005, 1e-3, 1e-4)  # parabola steps around the best alpha


def power_law_fit(
    curve: DataFrame,
    keys: Sequence[str],
    s: str = "s",
    v: str = "value",
    b_upper: str | None = "b_upper",
    alpha_bounds: tuple[float, float] = ALPHA_BOUNDS,
    min_points: int = 3,
) -> DataFrame:
    """a, alpha, b, sse, rmse, r2 per curve; too few points give nulls.

    ``b_upper`` names a column with the upper bound of b (None: unbounded).
    """
    keys = list(keys)
    lo, hi = alpha_bounds
    bound = F.greatest(F.col(b_upper).cast("double"), F.lit(1e-9)) if b_upper else F.lit(float("inf"))
    points = curve.select(*keys, F.col(s).cast("double").alias("__x"), F.col(v).cast("double").alias("__y"), bound.alias("__bu"))
    ok = F.col("__y").isNotNull() & ~F.isnan("__y") & (F.col("__x") > 0) & (F.col("__y") > 0)
    counts = points.groupBy(*keys).agg(F.count(F.when(ok, 1)).alias("n_points"))
    points = points.where(ok)
    steps = int(round((hi - lo) / STEP))
    grid = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: F.lit(lo) + i * F.lit(STEP))
    tried = _evaluate(points.withColumn("alpha", F.explode(grid)), keys).where(F.col("n") >= min_points)
    rank = F.when(F.col("sst") > 0, F.round(F.col("sse") / F.col("sst"), 12)).otherwise(F.lit(0.0))
    best = tried.groupBy(*keys).agg(F.min(F.struct(rank.alias("r"), "alpha")).alias("o")).select(*keys, F.col("o.alpha").alias("alpha"))
    for h in HALF_WIDTHS:
        best = _parabola(points, best, keys, h, lo, hi)
    fit = _evaluate(points.join(best, keys), keys)
    out = fit.select(
        *keys,
        "a",
        "alpha",
        "b",
        "sse",
        F.sqrt(F.col("sse") / F.col("n")).alias("rmse"),
        F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst")).alias("r2"),
    )
    return counts.join(out, keys, "left")


def _evaluate(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best bounded (a, b) and its error for each (curve, alpha).

    Where the free optimum breaks a bound the best point lies on an edge of
    the box (the problem is convex), so the three edges are compared.
    """
    m = rows.selectExpr(*keys, "alpha", "__y AS y", "power(__x, -alpha) AS u", "__bu").groupBy(*keys, "alpha").agg(
        F.expr("count(*) AS n"),
        F.expr("avg(u) AS um"),
        F.expr("avg(y) AS ym"),
        F.expr("var_pop(u) AS vu"),
        F.expr("var_pop(y) AS vy"),
        F.expr("covar_pop(u, y) AS cuy"),
        F.expr("max(__bu) AS bu"),
    )
    free = m.selectExpr("*", "CASE WHEN vu > 0 THEN cuy / vu ELSE 0D END AS a0", "vu + um * um AS square")
    edges = free.selectExpr(
        *keys, "alpha", "n", "um", "ym", "vu", "vy", "cuy",
        f"""CASE WHEN a0 >= {A_MIN} AND ym - a0 * um BETWEEN 0 AND bu
              THEN array(struct(a0 AS a, ym - a0 * um AS b))
              ELSE array(struct(greatest((cuy + um * ym) / square, {A_MIN}D) AS a, 0D AS b),
                         struct({A_MIN}D AS a, least(greatest(ym - {A_MIN}D * um, 0D), bu) AS b),
                         struct(greatest((cuy + um * ym - bu * um) / square, {A_MIN}D) AS a, bu AS b)) END AS points""",
    )
    error = "n * greatest(vy - 2 * p.a * cuy + p.a * p.a * vu + power(ym - p.a * um - p.b, 2), 0D)"
    best = f"array_min(transform(filter(points, p -> p.b < double('infinity')), p -> struct({error} AS sse, p.a AS a, p.b AS b)))"
    chosen = edges.selectExpr(*keys, "alpha", "n", "n * vy AS sst", f"{best} AS c")
    return chosen.selectExpr(*keys, "alpha", "n", "c.a AS a", "c.b AS b", "c.sse AS sse", "sst")


def _parabola(points: DataFrame, best: DataFrame, keys: Sequence[str], h: float, lo: float, hi: float) -> DataFrame:
    """Move alpha to the vertex of the parabola through the errors at alpha - h, alpha, alpha + h."""
    spots = best.selectExpr(*keys, "alpha AS centre", f"greatest(least({h}D, alpha - {lo}D, {hi}D - alpha), 0D) AS h")
    spots = spots.selectExpr("*", "explode(array(-1, 0, 1)) AS k").selectExpr("*", "centre + k * h AS alpha")
    tried = _evaluate(points.join(spots, list(keys)), [*keys, "centre", "h", "k"])
    three = tried.groupBy(*keys, "centre", "h").agg(
        F.expr("max(CASE WHEN k = -1 THEN sse END) AS l"),
        F.expr("max(CASE WHEN k = 0 THEN sse END) AS m"),
        F.expr("max(CASE WHEN k = 1 THEN sse END) AS r"),
    )
    move = "greatest(-h, least(h, h * (l - r) / (2 * (l - 2 * m + r))))"
    return three.selectExpr(*keys, f"centre + CASE WHEN h > 1e-9 AND l - 2 * m + r > 0 THEN {move} ELSE 0D END AS alpha")


def fitted_optimum(fits: DataFrame, keys: Sequence[str], n_eff: str = "n_eff", refine: bool = False) -> DataFrame:
    """s minimising (a s^-alpha + b) / (n_eff - s) on [1, n_eff - 1].

    Integer sizes by default; ``refine`` searches between the neighbours of the
    integer optimum on two finer grids. Fits without parameters give nulls.
    """

    def objective(q: Column) -> Column:
        return (F.col("a") * F.pow(q, -F.col("alpha")) + F.col("b")) / (F.col(n_eff) - q)

    grids = [F.transform(F.sequence(F.lit(1).cast("long"), F.col(n_eff) - 1), lambda i: i.cast("double"))]
    out = fits
    if refine:
        grids += [_around(step, n_eff) for step in (0.01, 0.0001)]
    for g in grids:
        best = F.array_min(F.transform(g, lambda q: F.struct(objective(q).alias("o"), q.alias("s"))))
        out = out.withColumn("__best", best).withColumn("__s", F.col("__best.s"))
    known = F.col("a").isNotNull()
    return out.withColumns(
        {"fitted_s_star": F.when(known, F.col("__s")), "fitted_objective": F.when(known, F.col("__best.o"))}
    ).drop("__best", "__s")


def _around(step: float, n_eff: str) -> Column:
    near = F.transform(F.sequence(F.lit(-100), F.lit(100)), lambda i: F.col("__s") + i * F.lit(step))
    return F.filter(near, lambda q: (q >= 1) & (q <= F.col(n_eff) - 1))


def scaling_fits(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fit, fitted optimum and the empirical best size per curve.

    ``curve`` has s, value, n_eff and b_upper next to the keys.
    """
    objective = F.when(F.col("n_eff") > F.col("s"), F.col("value") / (F.col("n_eff") - F.col("s")))
    observed = curve.groupBy(*keys).agg(
        F.min(F.when(objective.isNotNull(), F.struct(objective.alias("o"), F.col("s").alias("s")))).alias("e"),
        F.max("n_eff").alias("n_eff"),
    )
    fits = power_law_fit(curve, keys).join(observed, list(keys))
    out = fitted_optimum(fits, keys)
    return out.withColumns({"empirical_oracle_s": F.col("e.s"), "empirical_oracle_objective": F.col("e.o")}).drop("e")


def fit_by_method(curve: DataFrame, keys: Sequence[str], min_points: int = 3, **options) -> DataFrame:
    """Mean curve over replications, then one fit per method."""
    mean = curve.groupBy(*keys, "s").agg(F.avg("value").alias("value"), F.max("b_upper").alias("b_upper"))
    return power_law_fit(mean, keys, min_points=min_points, **options)


def holdout_error(curve: DataFrame, keys: Sequence[str], split_s: int) -> DataFrame:
    """Fit the sizes up to split_s; median relative error of the later sizes per curve."""
    fits = power_law_fit(curve.where(F.col("s") <= split_s), keys)
    later = curve.where(F.col("s") > split_s).join(fits, list(keys))
    pred = F.col("a") * F.pow(F.col("s").cast("double"), -F.col("alpha")) + F.col("b")
    err = F.abs(pred - F.col("value")) / F.col("value")
    return later.groupBy(*keys).agg(F.percentile(err, F.lit(0.5)).alias("median_relative_error"), F.count(F.lit(1)).alias("n_points"))


def trim_replications(values: DataFrame, by: Sequence[str], value: str, k: int = 1, replication: str = "replication") -> DataFrame:
    """Drop the k lowest and k highest replications of each group."""
    low = W.partitionBy(*by).orderBy(F.col(value).asc(), replication)
    high = W.partitionBy(*by).orderBy(F.col(value).desc(), F.col(replication).desc())
    ranked = values.withColumns({"__lo": F.row_number().over(low), "__hi": F.row_number().over(high)})
    return ranked.where((F.col("__lo") > k) & (F.col("__hi") > k)).drop("__lo", "__hi")


def rampup_replay(curve: DataFrame, keys: Sequence[str], min_points: int = 4, pick: str = "best_seen") -> DataFrame:
    """Replay sizes in order, refitting the seen prefix, until the fitted optimum is reached.

    Each point is copied into the later stages of its own curve (a dozen rows),
    all prefixes are fitted together, and the first stage whose optimum lies
    within the seen sizes stops the curve; else the last stage does. The choice
    is the best seen size by fitted objective, or the largest (``pick``).
    """
    stage = W.partitionBy(*keys).orderBy("s")
    whole = W.partitionBy(*keys)
    staged = curve.withColumn("stage", F.row_number().over(stage)).withColumn("stages", F.count(F.lit(1)).over(whole))
    objective = F.when(F.col("n_eff") > F.col("s"), F.col("value") / (F.col("n_eff") - F.col("s")))
    observed = staged.withColumn("objective", objective)
    prefix = observed.withColumn("at", F.explode(F.sequence(F.col("stage"), F.col("stages")))).where(F.col("at") >= min_points)
    fits = power_law_fit(prefix, [*keys, "at"])
    seen = prefix.groupBy(*keys, "at").agg(
        F.max("s").alias("largest"),
        F.max("stages").alias("stages"),
        F.max("n_eff").alias("n_eff"),
        F.array_sort(F.collect_list("s")).alias("sizes"),
    )
    tried = fitted_optimum(fits.join(seen, [*keys, "at"]), [*keys, "at"])
    halt = (F.col("at") == F.col("stages")) | (F.col("fitted_s_star") <= F.col("largest"))
    cols = ["at", "largest", "sizes", "a", "alpha", "b", "r2", "fitted_s_star", "n_eff"]
    stopped = tried.where(halt).groupBy(*keys).agg(F.min(F.struct(*cols)).alias("t")).select(*keys, "t.*")

    def law(q: Column) -> Column:
        return (F.col("a") * F.pow(q.cast("double"), -F.col("alpha")) + F.col("b")) / (F.col("n_eff") - q)

    usable = F.filter("sizes", lambda q: q < F.col("n_eff"))
    best = F.array_min(F.transform(usable, lambda q: F.struct(law(q).alias("o"), q.alias("s"))))
    if pick == "largest":
        best = F.struct(law(F.col("largest")).alias("o"), F.col("largest").alias("s"))
    elif pick != "best_seen":
        raise ValueError(f"unknown pick rule: {pick}")
    chosen = stopped.withColumn("best", best).withColumns({"ramp_s": F.col("best.s"), "ramp_fitted_objective": F.col("best.o")})
    oracle = observed.groupBy(*keys).agg(
        F.min(F.when(F.col("objective").isNotNull(), F.struct("objective", "s"))).alias("e")
    )
    at_choice = observed.select(*keys, F.col("s").alias("ramp_s"), F.col("objective").alias("ramp_objective"))
    out = chosen.join(oracle, list(keys)).join(at_choice, [*keys, "ramp_s"])
    return out.select(
        *keys,
        F.col("at").cast("long").alias("stopped_stage"),
        F.col("largest").alias("stopped_largest_s"),
        F.array_join(F.transform("sizes", lambda q: q.cast("string")), ",").alias("observed_sizes"),
        F.col("fitted_s_star").alias("ramp_fitted_s_star"),
        "ramp_s",
        "ramp_fitted_objective",
        F.col("e.s").alias("oracle_s"),
        "ramp_objective",
        F.col("e.objective").alias("oracle_objective"),
        F.when(F.col("e.objective") > 0, (F.col("ramp_objective") - F.col("e.objective")) / F.col("e.objective")).alias("regret"),
        (F.col("ramp_s") == F.col("e.s")).alias("exact_match"),
        F.col("a").alias("fit_a"),
        F.col("alpha").alias("fit_alpha"),
        F.col("b").alias("fit_b"),
        F.col("r2").alias("fit_r2"),
    )


def rampup_summary(replay: DataFrame, by: Sequence[str]) -> DataFrame:
    n = F.count(F.lit(1))
    return replay.groupBy(*by).agg(
        n.alias("n_replications"),
        F.avg("regret").alias("mean_regret"),
        F.percentile("regret", F.lit(0.5)).alias("median_regret"),
        F.when(n > 1, F.stddev_samp("regret")).otherwise(F.lit(0.0)).alias("sd_regret"),
        F.min("regret").alias("min_regret"),
        F.max("regret").alias("max_regret"),
        F.avg(F.col("exact_match").cast("double")).alias("exact_match_rate"),
        F.avg("ramp_s").alias("mean_ramp_s"),
        F.avg("oracle_s").alias("mean_oracle_s"),
    )


def rampup_savings(curve: DataFrame, replay: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of fits and of training labels the early stop avoids."""
    joined = curve.join(replay.select(*keys, "stopped_largest_s"), list(keys))
    used = F.col("s") <= F.col("stopped_largest_s")
    return joined.groupBy(*keys).agg(
        F.count(F.when(used, 1)).alias("fits_used"),
        F.count(F.lit(1)).alias("fits_all"),
        (1 - F.count(F.when(used, 1)) / F.count(F.lit(1))).alias("fit_count_saving"),
        (1 - F.sum(F.when(used, F.col("s")).otherwise(0)) / F.sum("s")).alias("label_effort_saving"),
    )


def loss_comparison(cells: DataFrame, pairs: Sequence[tuple[str, str]], values: Sequence[str], main: str) -> DataFrame:
    """Mean metrics per (loss, s), plus difference rows for each named pair of losses."""
    from .joins import append_rows, outcome_pair_compare

    means = cells.groupBy("loss", "s").agg(*[F.avg(v).alias(v) for v in values])
    out = means
    for left, right in pairs:
        out = append_rows(out, outcome_pair_compare(means, left, right, s="s", value=main))
    return out


# 97.5 % points of Student's t by degrees of freedom.
T_975 = (
    12.706204736, 4.302652730, 3.182446305, 2.776445105, 2.570581836, 2.446911851, 2.364624252, 2.306004135,
    2.262157163, 2.228138852, 2.200985160, 2.178812830, 2.160368656, 2.144786688, 2.131449546, 2.119905299,
    2.109815578, 2.100922040, 2.093024054, 2.085963447, 2.079613845, 2.073873068, 2.068657610, 2.063898562,
    2.059538553, 2.055529439, 2.051830516, 2.048407142, 2.045229642, 2.042272456,
)


def t_quantile(df: Column) -> Column:
    """97.5 % point; a series in 1/df beyond the table (error below 1e-6)."""
    z = 1.959963984540054
    g1 = (z**3 + z) / 4
    g2 = (5 * z**5 + 16 * z**3 + 3 * z) / 96
    g3 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    series = F.lit(z) + F.lit(g1) / df + F.lit(g2) / (df * df) + F.lit(g3) / (df * df * df)
    table = F.element_at(F.array(*[F.lit(t) for t in T_975]), F.least(df, F.lit(len(T_975))).cast("int"))
    return F.when(df < 1, F.lit(None).cast("double")).when(df <= len(T_975), table).otherwise(series)


def curve_summary_t(curve: DataFrame, by: Sequence[str], value: str = "value", replicated: bool = True) -> DataFrame:
    """Mean, sd, se and Student-t band; one value alone gets a band of width 0."""
    v = F.when(~F.isnan(value), F.col(value))
    s = curve.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("__sd"))
    many = (F.col("n") > 1) & F.lit(replicated)
    se = F.col("__sd") / F.sqrt("n")
    half = F.when(many, t_quantile(F.greatest(F.col("n") - 1, F.lit(1))) * se).otherwise(F.lit(0.0))
    return s.withColumns(
        {
            "sd": F.when(many, F.col("__sd")),
            "se": F.when(many, se),
            "ci95_low": F.col("mean") - half,
            "ci95_high": F.col("mean") + half,
        }
    ).drop("__sd")


def curve_summary_z(curve: DataFrame, by: Sequence[str], value: str, means: Sequence[str] = ()) -> DataFrame:
    """Mean, sd (0 for one value), se and 1.96 band, plus plain means of other columns."""
    n = F.count(F.lit(1))
    sd = F.when(n > 1, F.stddev_samp(value)).otherwise(F.lit(0.0))
    s = curve.groupBy(*by).agg(n.alias("replications"), F.avg(value).alias("mean"), sd.alias("sd"), *[F.avg(m).alias(f"{m}_mean") for m in means])
    se = F.col("sd") / F.sqrt("replications")
    return s.withColumns({"se": se, "ci_low": F.col("mean") - 1.96 * se, "ci_high": F.col("mean") + 1.96 * se})


def constant_baseline_var(population: DataFrame, y: str) -> DataFrame:
    return population.agg(F.var_samp(y).alias("baseline_var"), F.count(y).alias("n"))
