"""Coefficient tables: one moment pass, then one evaluation pass for all fits."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import influence as I
from ..operators.moments import moments_of
from ..session import materialise


def coef_summary(
    df: DataFrame, targets: Sequence[str], controlled: Sequence[str], y: str, ridge: float = 0.0
) -> DataFrame:
    """Marginal and controlled row per target of the preference family (ddof 0)."""
    rule = replace(I.RIDGE_RULES["preference"], ridge=ridge)
    names = list(dict.fromkeys([*targets, *controlled]))
    rows = materialise(df.select(y, *names).na.drop(subset=[y, *names]), "regression")
    m = moments_of(rows, names, y)[()]
    fits = {}
    for t in targets:
        fits[f"marginal:{t}"] = I.fit_ols(m, t, [t], y, rule)
        if t in controlled:
            fits[f"controlled:{t}"] = I.fit_ols(m, t, list(controlled), y, rule)
    stats = I.influence_table(rows, fits, y, ddof=0)
    shares = rows.agg(
        F.array(
            *[
                F.struct(
                    F.lit(t).alias("target"),
                    F.avg((F.abs(F.col(t)) > 1e-12).cast("double")).alias("nonzero_share"),
                    F.avg(t).alias("raw_mean"),
                    F.stddev_pop(t).alias("raw_sd"),
                )
                for t in targets
            ]
        ).alias("r")
    ).select(F.explode("r").alias("r")).select("r.*")
    out = I.fit_table(rows, fits).join(F.broadcast(stats), "fit").join(F.broadcast(shares), "target")
    se = F.sqrt(F.col("if_var") / F.col("n"))
    return out.withColumns(
        {
            "model": F.split("fit", ":")[0],
            "abs_beta": F.abs("beta"),
            "ifvar": F.col("if_var"),
            "se_full_population": se,
            "ci95_half_width_full_population": F.lit(1.96) * se,
            "effect_of_doubling": F.when(F.col("target").startswith("delta_log_length"), F.col("beta") * F.lit(math.log(2.0))),
        }
    ).drop("fit", "if_var", "zero_if_var", "zero_mse", "if_mean", "if_ess_share")


def candidate_summary(
    df: DataFrame,
    features: Mapping[str, str],
    y: str,
    controls: Sequence[str] = (),
    ridge: float = 0.0,
    unit: float = 5.0,
) -> DataFrame:
    """Single-text family: OLS and IF statistics on target rows, raw spread on all rows (ddof 1).

    ``features`` maps each scaled feature to its raw column.
    """
    rule = replace(I.RIDGE_RULES["single_text"], ridge=ridge)
    df = materialise(df.select("split", y, *features, *dict.fromkeys(features.values())), "candidates")
    target = df.where(F.col("split") == "target")
    m = moments_of(target, list(features), y)[()]
    fits = {f: I.fit_ols(m, f, [f, *[c for c in controls if c != f]], y, rule) for f in features}
    stats = I.influence_table(target, fits, y, ddof=1)
    quantiles = I.exact_quantiles_of(df, {raw: F.col(raw) for raw in features.values()}, [0.05, 0.5, 0.95])
    structs = []
    for f, raw in features.items():
        q = F.array(*[F.lit(v).cast("double") for v in quantiles[raw]])
        structs.append(
            F.struct(
                F.lit(f).alias("fit"),
                F.lit(raw).alias("raw_feature"),
                F.avg((F.abs(F.col(raw)) > 1e-12).cast("double")).alias("nonzero_share"),
                F.avg(raw).alias("raw_mean"),
                F.stddev_pop(raw).alias("raw_sd"),
                q[0].alias("raw_p05"),
                q[1].alias("raw_p50"),
                q[2].alias("raw_p95"),
            )
        )
    raws = df.agg(F.array(*structs).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    out = I.fit_table(target, fits).join(F.broadcast(stats), "fit").join(F.broadcast(raws), "fit")
    points = F.lit(unit) * F.col("beta")
    per_unit = F.when(F.col("raw_sd") > 0, points / F.col("raw_sd"))
    return out.select(
        F.col("fit").alias("feature"),
        "raw_feature",
        "nonzero_share",
        "raw_mean",
        "raw_sd",
        "raw_p05",
        "raw_p50",
        "raw_p95",
        F.col("beta").alias("beta_scaled_y"),
        points.alias("beta_raw_points"),
        per_unit.alias("beta_raw_unit_points"),
        F.abs(points).alias("abs_beta_raw_points"),
        F.abs(per_unit).alias("abs_beta_raw_unit_points"),
        F.col("if_var").alias("direct_ifvar"),
        F.col("residual_var").alias("direct_residual_var"),
        "hessian_condition",
        "if_weight_p50",
        "if_weight_p90",
        "if_weight_p95",
        "if_weight_p99",
        "if_weight_max",
        F.col("feature_columns").alias("active_regression_features"),
        (
            (F.col("nonzero_share") >= 0.03)
            & (F.col("if_weight_p99") <= 10.0)
            & F.col("hessian_condition").isNotNull()
        ).alias("passes_stability"),
    )


def spec_enumerate(
    spark, targets: Sequence[str], pool: Sequence[str], final_controls: Sequence[str], dimensions: Sequence[int]
) -> DataFrame:
    """Target alone, target with every k controls, and with the final controls.

    The names are a fixed list. A spec grows by exploding the controls that come
    later in the pool, so no combination is built twice.
    """
    t = spark.createDataFrame([(x,) for x in targets], "target string")
    places = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(x).alias("control")) for i, x in enumerate(pool)])
    grown = t.select("target", F.lit(-1).alias("last"), F.array().cast("array<string>").alias("controls"))
    parts = []
    for dim in range(1, max(dimensions) + 1):
        if dim > 1:
            later = F.filter(places, lambda p: (p["pos"] > F.col("last")) & (p["control"] != F.col("target")))
            grown = grown.withColumn("p", F.explode(later)).select(
                "target", F.col("p.pos").alias("last"), F.concat("controls", F.array("p.control")).alias("controls")
            )
        if dim in dimensions:
            family = "target_only" if dim == 1 else f"target_plus_{dim - 1}"
            parts.append(grown.select("target", "controls", F.lit(family).alias("family")))
    final = F.array(*[F.lit(x) for x in final_controls]) if final_controls else F.array().cast("array<string>")
    last = t.select("target", F.filter(final, lambda x: x != F.col("target")).alias("controls"), F.lit("final_controls").alias("family"))
    parts.append(last.where(F.size("controls") > 0))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    short = F.transform(F.concat(F.array("target"), F.col("controls")), lambda x: F.regexp_replace(x, "^delta_", ""))
    return out.dropDuplicates(["target", "controls", "family"]).select(
        F.array_join(short, "__").alias("spec_id"),
        "target",
        "controls",
        (F.size("controls") + 1).alias("dimension"),
        "family",
    )


def spec_summary(df: DataFrame, specs: DataFrame, y: str, budgets: Sequence[int] = ()) -> DataFrame:
    """Statistics of every spec from one superset moment matrix (ddof 1)."""
    listed = [(r["spec_id"], r["family"], r["target"], list(r["controls"])) for r in specs.collect()]  # a fixed, short list
    names = sorted({t for _, _, t, _ in listed} | {c for *_, cs in listed for c in cs})
    df = materialise(df.select("split", y, *names), "specs")
    target = df.where(F.col("split") == "target")
    m = moments_of(target, names, y)[()]
    fits = {f"{s}|{f}": I.fit_ols(m, t, [t, *cs], y, I.RIDGE_RULES["single_text"]) for s, f, t, cs in listed}
    stats = I.influence_table(target, fits, y, ddof=1)
    shares = df.agg(
        F.array(*[F.struct(F.lit(t).alias("target"), F.avg((F.col(t) != 0).cast("double")).alias("nonzero_share")) for t in sorted({t for _, _, t, _ in listed})]).alias("r")
    ).select(F.explode("r").alias("r")).select("r.*")
    out = I.fit_table(target, fits).join(F.broadcast(stats), "fit").join(F.broadcast(shares), "target")
    out = out.select(
        F.split("fit", "[|]")[0].alias("spec_id"),
        F.split("fit", "[|]")[1].alias("family"),
        "target",
        "feature_columns",
        F.size(F.split("feature_columns", ",")).alias("dimension"),
        "nonzero_share",
        "beta",
        F.abs("beta").alias("abs_beta"),
        F.col("if_var").alias("ifvar"),
        "hessian_condition",
        "if_weight_p50",
        "if_weight_p90",
        "if_weight_p95",
        "if_weight_p99",
        "if_weight_max",
        (
            (F.col("nonzero_share") >= 0.15)
            & (F.col("if_weight_p99") <= 10.0)
            & F.col("hessian_condition").isNotNull()
        ).alias("passes_stability"),
    )
    half = {f"direct_ci_halfwidth_B{b}": F.lit(1.96) * F.sqrt(F.greatest(F.col("ifvar"), F.lit(0.0)) / b) for b in budgets}
    return out.withColumns(half) if half else out


def candidate_diagnostics(
    df: DataFrame, metadata: DataFrame, core_controls: Sequence[str], y: str, prediction: str | None, budgets: Sequence[int]
) -> DataFrame:
    """Headline family: every candidate with its eligible controls (ddof 0)."""
    meta = {r["feature"]: r for r in metadata.collect()}  # one row per feature
    family = {f: r["family"] for f, r in meta.items()}
    target = df.where(F.col("split") == "target")
    m = moments_of(target, list(meta), y)[()]
    controls = {f: I.eligible_controls(m, f, core_controls, family) for f in meta}
    fits = {f: I.fit_ols(m, f, [f, *controls[f]], y) for f in meta}
    stats = I.influence_table(target, fits, y, ddof=0)
    pred = F.col(prediction) if prediction else F.lit(0.0)
    structs = [
        F.struct(
            F.lit(f).alias("fit"),
            F.var_pop(I.if_weight(fits[f]) * (F.col(y) - pred)).alias("surrogate_ifvar"),
            F.avg((F.abs(F.col(f"{f}_raw")) > 1e-12).cast("double")).alias("nonzero_share"),
            F.stddev_pop(f"{f}_raw").alias("sd_raw"),
        )
        for f in meta
    ]
    extra = target.agg(F.array(*structs).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    # one row per (feature, value), merged before the shuffle: no set of values is ever collected
    named = F.array(*[F.struct(F.lit(f).alias("fit"), F.col(f"{f}_raw").cast("double").alias("x")) for f in meta])
    values = target.select(F.explode(named).alias("v")).select("v.*").where(F.col("x").isNotNull()).distinct()
    unique = values.groupBy("fit").agg(F.count("*").alias("unique_values"))
    rows = [(f, ",".join(controls[f]), _finite(float(I.vif(m, f, controls[f]))), float(I.max_abs_corr(m, f, controls[f]))) for f in meta]
    side = df.sparkSession.createDataFrame(
        rows, "fit string, controls string, target_vif double, max_abs_corr_with_controls double"
    )
    out = I.fit_table(target, fits)
    for t in (stats, extra, side):
        out = out.join(F.broadcast(t), "fit")
    out = out.join(unique, "fit", "left").withColumn("unique_values", F.coalesce("unique_values", F.lit(0)))
    note = F.col("note") if "note" in metadata.columns else F.lit(None).cast("string")
    out = out.join(F.broadcast(metadata.select(F.col("feature").alias("fit"), "family", "kind", "priority", note.alias("note"))), "fit")
    zero, ols = F.col("zero_if_var"), F.col("if_var")
    out = out.select(
        F.col("fit").alias("feature"),
        "family",
        "kind",
        "priority",
        "note",
        "controls",
        F.col("beta").alias("beta_controlled"),
        F.abs("beta").alias("abs_beta_controlled"),
        "nonzero_share",
        "unique_values",
        "sd_raw",
        "target_vif",
        "max_abs_corr_with_controls",
        "hessian_condition",
        ols.alias("ols_ifvar"),
        zero.alias("zero_surrogate_ifvar"),
        F.col("surrogate_ifvar").alias("tfidf_ifvar"),
        F.when(zero > 0, F.col("surrogate_ifvar") / zero).alias("tfidf_ifvar_ratio_vs_zero"),
        F.when(ols > 0, F.col("surrogate_ifvar") / ols).alias("tfidf_ifvar_ratio_vs_ols"),
        F.col("if_weight_p50").alias("if_weight_p50_abs"),
        F.col("if_weight_p90").alias("if_weight_p90_abs"),
        F.col("if_weight_p95").alias("if_weight_p95_abs"),
        F.col("if_weight_p99").alias("if_weight_p99_abs"),
        F.col("if_weight_max").alias("if_weight_max_abs"),
        "if_ess_share",
    )
    return out.withColumns(
        {f"direct_ci_halfwidth_B{b}": F.lit(1.96) * F.sqrt(F.greatest(F.col("ols_ifvar"), F.lit(0.0)) / b) for b in budgets}
    )


def _finite(x: float) -> float | None:
    return x if math.isfinite(x) else None
