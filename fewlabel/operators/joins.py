"""Joins the experiments need; no join here builds a cross product."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .population import affine_scale


def subset_by_ids(members: DataFrame, population: DataFrame, id_: str, role: str, y: str) -> DataFrame:
    """Members joined one to one to the population, with role and scaled outcome.

    A duplicate member or an id the population lacks stops the job.
    """
    counts = members.groupBy(id_).agg(F.count(F.lit(1)).alias("__copies"), F.min("rank").alias("rank"))
    joined = counts.join(population.withColumn("__known", F.lit(True)), id_, "left")
    guard = (
        F.when(F.col("__copies") > 1, F.raise_error(F.lit(f"{role} has duplicate ids")))
        .when(F.col("__known").isNull(), F.raise_error(F.lit(f"{role} contains unknown ids")))
        .otherwise(F.lit(role))
    )
    return joined.withColumns(
        {"split_role": guard.cast("string"), "y_raw": F.col(y).cast("double"), "y_scaled": affine_scale(F.col(y).cast("double"))}
    ).drop("__copies", "__known")


def semi_population(population: DataFrame, ids: DataFrame, id_: str) -> DataFrame:
    return population.join(ids.select(id_), id_, "left_semi")


def anti_remainder(population: DataFrame, ids: DataFrame, id_: str) -> DataFrame:
    return population.join(ids.select(id_), id_, "left_anti")


def budget_feasible(curve: DataFrame, budgets: Sequence[int], s: str = "s", out: str = "budget", positive: bool = False) -> DataFrame:
    """One row per (curve row, budget above s): budgets are exploded in the row itself."""
    above = F.filter(F.array(*[F.lit(int(b)).cast("long") for b in budgets]), lambda b: b > F.col(s))
    rows = curve.where(F.col(s) > 0) if positive else curve
    return rows.withColumn(out, F.explode(above))


def lookup(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left lookup of a table with unique keys; the planner broadcasts it if its bytes allow."""
    return rows.join(table, key, "left")


def embedding_lookup(rows: DataFrame, text: str, vectors: DataFrame, dim: int, out: str = "embedding") -> DataFrame:
    """Vector of each text; a text without one gets zeros and is flagged.

    ``vectors`` has unique texts. The join is by the hash of the text; a text
    that repeats in a third of the rows makes one long partition, which the
    adaptive skew join splits (the unique side is copied, never the pairs).
    """
    from ..functions.text import normalize_text

    keyed = rows.withColumn("__h", F.sha2(normalize_text(F.col(text)), 256))
    table = vectors.select(F.sha2("text", 256).alias("__h"), F.col("embedding").alias("__v"))
    joined = keyed.join(table, "__h", "left")
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return joined.withColumns(
        {out: F.coalesce(F.col("__v"), zeros), f"{out}_missing": F.col("__v").isNull()}
    ).drop("__h", "__v")


def outcome_pair_compare(means: DataFrame, left: str, right: str, method: str = "loss", s: str = "s_train", value: str = "value") -> DataFrame:
    """Difference of two methods' means at equal s, absolute and relative."""
    a = means.where(F.col(method) == left).select(s, F.col(value).alias("__l"))
    b = means.where(F.col(method) == right).select(s, F.col(value).alias("__r"))
    return a.join(b, s).select(
        F.lit(f"{left}_minus_{right}").alias(method),
        s,
        (F.col("__l") - F.col("__r")).alias(value),
        F.when(F.col("__r") != 0, (F.col("__l") - F.col("__r")) / F.col("__r")).alias(f"{value}_relative_delta"),
    )


def append_rows(rows: DataFrame, more: DataFrame) -> DataFrame:
    return rows.unionByName(more, allowMissingColumns=True)
