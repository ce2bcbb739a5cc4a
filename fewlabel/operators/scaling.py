"""Standardising columns, deltas between arms, and feature inspection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import exact_quantiles


def _one_row(df: DataFrame, aggs: Mapping[str, Column]) -> Column:
    """All statistics in one pass, as a scalar subquery of the query that uses them."""
    stats = df.agg(*[c.alias(n) for n, c in aggs.items()])
    return stats.select(F.struct(*aggs)).scalar()


def _ratio(num: Column, sd: Column) -> Column:
    return F.when(sd > 0, num / sd).otherwise(F.lit(0.0))


def zscore(df: DataFrame, columns: Mapping[str, str], keep_stats: bool = False) -> DataFrame:
    """out = (x - mean) / population sd; a constant column becomes 0."""
    aggs = {}
    for c in columns.values():
        aggs[f"{c}_mean"] = F.avg(c)
        aggs[f"{c}_sd"] = F.stddev_pop(c)
    s = _one_row(df, aggs)
    out = {o: _ratio(F.col(c) - s[f"{c}_mean"], s[f"{c}_sd"]) for o, c in columns.items()}
    if keep_stats:
        for o, c in columns.items():
            out[f"{o}_mean"] = s[f"{c}_mean"]
            out[f"{o}_sd"] = s[f"{c}_sd"]
    return df.withColumns(out)


def scale_no_center(df: DataFrame, columns: Mapping[str, str], zero_sd: str = "zero") -> DataFrame:
    """out = x / population sd, null -> 0, so swapping the arms flips the sign."""
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns.values()}
    s = _one_row(df, {f"{c}_sd": F.stddev_pop(x) for c, x in filled.items()})
    out = {}
    for o, c in columns.items():
        sd = s[f"{c}_sd"]
        if zero_sd == "raise":
            bad = F.raise_error(F.lit(f"cannot scale {c}: zero spread")).cast("double")
            out[o] = F.when(sd > 0, filled[c] / sd).otherwise(bad)
        else:
            out[o] = _ratio(filled[c], sd)
    return df.withColumns(out)


def standardize_y(
    df: DataFrame, y: str, train: Column, out: str = "y_scaled", enabled: bool = True
) -> DataFrame:
    """Mean and sd of y over the train pool only; a tiny sd counts as 1."""
    if not enabled:
        return df.withColumn(out, F.col(y).cast("double"))
    on_train = F.when(train, F.col(y).cast("double"))
    s = _one_row(df, {"m": F.avg(on_train), "sd": F.stddev_pop(on_train)})
    sd = F.when(s["sd"] > 1e-8, s["sd"]).otherwise(F.lit(1.0))
    return df.withColumn(out, (F.col(y).cast("double") - s["m"]) / sd)


def winsorize(df: DataFrame, column: str, low: float = 0.01, high: float = 0.99, out: str | None = None) -> DataFrame:
    q_low, q_high = exact_quantiles(df, F.col(column), [low, high])
    return df.withColumn(out or column, F.least(F.greatest(F.col(column), F.lit(q_low)), F.lit(q_high)))


def arm_delta(
    df: DataFrame, features: Sequence[str], kinds: Mapping[str, str], a: str = "a_", b: str = "b_"
) -> DataFrame:
    """delta_f_raw = a_f - b_f; continuous deltas are divided by their sd, others kept."""
    raw = df.withColumns(
        {f"delta_{f}_raw": F.col(f"{a}{f}").cast("double") - F.col(f"{b}{f}").cast("double") for f in features}
    )
    scaled = {f"delta_{f}": f"delta_{f}_raw" for f in features if kinds.get(f, "continuous") == "continuous"}
    out = scale_no_center(raw, scaled) if scaled else raw
    plain = [f for f in features if f"delta_{f}" not in scaled]
    return out.withColumns({f"delta_{f}": F.coalesce(F.col(f"delta_{f}_raw"), F.lit(0.0)) for f in plain})


def feature_kinds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """ternary, binary or continuous per column, in at most three aggregate passes.

    A column of at most five distinct values that round to -1, 0 and 1 is
    ternary; one without values strictly between its minimum and maximum has at
    most two and is binary. No distinct values are collected: a pass brings few
    numbers per column to the driver, so later ones work with literals.
    """
    aggs = []
    for c in columns:
        outside = ~F.round(F.col(c), 8).isin(-1.0, 0.0, 1.0)
        aggs += [F.count(F.when(outside, 1)).alias(f"{c}__other"), F.min(c).alias(f"{c}__min"), F.max(c).alias(f"{c}__max")]
    first = df.agg(*aggs).first()
    near = [c for c in columns if first[f"{c}__other"] == 0]
    if near:
        values = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("x")) for c in near])).alias("v"))
        many = {r["c"] for r in values.where("v.x is not null").select("v.c", "v.x").distinct().groupBy("c").count().where("count > 5").collect()}
    kinds = {c: "ternary" for c in near if c not in many}
    rest = [c for c in columns if c not in kinds]
    if rest:
        between = [
            F.count(F.when((F.col(c) > F.lit(first[f"{c}__min"])) & (F.col(c) < F.lit(first[f"{c}__max"])), 1)).alias(c) for c in rest
        ]
        inner = df.agg(*between).first()
        kinds |= {c: "binary" if inner[c] == 0 else "continuous" for c in rest}
    return df.sparkSession.createDataFrame([(c, kinds[c]) for c in columns], "feature string, kind string")


def usable_features(df: DataFrame, columns: Sequence[str], max_features: int | None = None) -> DataFrame:
    """Columns whose population sd exceeds 1e-12, in the given order, first k."""
    stats = df.agg(*[F.stddev_pop(c).alias(c) for c in columns])
    structs = [
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature"), F.col(c).alias("sd"))
        for i, c in enumerate(columns)
    ]
    long = stats.select(F.explode(F.array(*structs)).alias("r")).select("r.*").where(F.col("sd") > 1e-12)
    return long if max_features is None else long.orderBy("position").limit(max_features)


def arm_traffic_filter(
    df: DataFrame,
    min_impressions_per_arm: float | None = None,
    min_total_impressions: float | None = None,
    min_clicks_per_arm: float | None = None,
) -> DataFrame:
    if min_impressions_per_arm is not None:
        df = df.where(F.least("impressions_a", "impressions_b") >= min_impressions_per_arm)
    if min_total_impressions is not None:
        df = df.where(F.col("impressions_a") + F.col("impressions_b") >= min_total_impressions)
    if min_clicks_per_arm is not None:
        df = df.where(F.least("clicks_a", "clicks_b") >= min_clicks_per_arm)
    return df


def eb_logit_ctr_diff(df: DataFrame, tau: float = 1000.0, out: str = "y_logit_ctr_diff") -> DataFrame:
    """Log-odds difference of click rates shrunk to the pooled rate with weight tau."""
    s = _one_row(
        df,
        {
            "clicks": F.sum(F.col("clicks_a") + F.col("clicks_b")),
            "imps": F.sum(F.col("impressions_a") + F.col("impressions_b")),
        },
    )
    pooled = s["clicks"] / s["imps"]

    def logit(arm: str) -> Column:
        p = (F.col(f"clicks_{arm}") + F.lit(tau) * pooled) / (F.col(f"impressions_{arm}") + F.lit(tau))
        return F.log(p / (F.lit(1.0) - p))

    return df.withColumn(out, logit("a") - logit("b"))


def standardize_embedding(
    df: DataFrame, vector: str, train: Column, dim: int, out: str | None = None, eps: float = 1e-6
) -> DataFrame:
    """Per-dimension mean and sd of the train pool; sd below eps counts as 1.

    The statistics are one vector aggregate (partial sums per task, two arrays
    in the end) and come back to the rows as a scalar subquery.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    pool = df.where(train).select(array_to_vector(vector).alias("v"))
    got = pool.select(Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("s"))
    shrink = (F.col("s.count") - 1) / F.col("s.count")
    sd = F.transform(vector_to_array("s.variance"), lambda v: F.sqrt(v * shrink))
    sd = F.transform(sd, lambda v: F.when(v < eps, 1.0).otherwise(v))
    s = got.select(F.struct(vector_to_array("s.mean").alias("m"), sd.alias("sd"))).scalar()
    rows = df.withColumns({"__m": s["m"], "__sd": s["sd"]})
    centred = F.zip_with(F.col(vector), F.col("__m"), lambda v, m: v.cast("double") - m)
    return rows.withColumn(out or vector, F.zip_with(centred, F.col("__sd"), lambda v, d: v / d)).drop("__m", "__sd")


def pair_embedding(a: Column, b: Column, mode: str = "b_minus_a", absolute: bool = False) -> Column:
    """Difference of two vectors, optionally followed by its absolute values."""
    if mode not in ("a_minus_b", "b_minus_a"):
        raise ValueError(f"unknown pair mode: {mode}")
    left, right = (a, b) if mode == "a_minus_b" else (b, a)
    diff = F.zip_with(left, right, lambda x, y: x - y)
    full = F.concat(diff, F.transform(diff, F.abs)) if absolute else diff
    return F.when(F.size(a) == F.size(b), full).otherwise(F.raise_error(F.lit("embedding sizes differ")))


def antisymmetric_score(forward: Column, swapped: Column) -> Column:
    return F.lit(0.5) * (forward - swapped)
