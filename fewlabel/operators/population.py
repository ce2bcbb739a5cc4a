"""Cleaning and simple projections of a population table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import require_columns


def clean_population(
    df: DataFrame, text: str, y: str | None, id_: str, keep: Sequence[str] = ()
) -> DataFrame:
    """Drop null texts and outcomes and keep, per text, the row of the lowest id.

    The lowest id of each text is found on narrow (hash, id) rows, reduced
    before their shuffle even if one text fills a third of the table; the rows
    are then kept by that id, which must be unique. Columns the caller does not
    use later never leave the scan.
    """
    needed = [text, id_, *([y] if y else []), *keep]
    require_columns(df, needed)
    rows = df.select(*dict.fromkeys(needed)).where(F.col(text).isNotNull())
    if y:
        rows = rows.where(F.col(y).isNotNull()).withColumn(y, F.col(y).cast("double"))
    return rows.join(first_ids(rows, text, id_), id_, "left_semi")


def first_ids(rows: DataFrame, text: str, id_: str) -> DataFrame:
    """The lowest id of each distinct text, as one narrow column."""
    h = F.sha2(F.col(text), 256)
    digest = [F.conv(F.substring(h, i, 15), 16, 10).cast("long").alias(f"__h{i}") for i in (1, 16, 31)]
    return rows.groupBy(*digest).agg(F.min(id_).alias(id_)).select(id_)


def dense_id(df: DataFrame, id_: str, out: str = "sample_id", seed: int = 0) -> DataFrame:
    """Dense 0..n-1 id in hash order, without a global sort.

    Hash buckets are even whatever the ids look like, so no task gets more than
    its share even when the existing ids are clustered.
    """
    from ..functions.hashing import hash_key
    from .ranking import hash_rank

    ranked = hash_rank(df, hash_key(seed, "dense", F.col(id_)), id_, out="__r")
    return ranked.withColumn(out, F.col("__r") - 1).drop("__r")


def filter_positive(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).cast("double") > 0)


def affine_scale(y: Column, centre: float = 90.0, unit: float = 5.0) -> Column:
    return (y - F.lit(centre)) / F.lit(unit)


def affine_unscale(y: Column, centre: float = 90.0, unit: float = 5.0) -> Column:
    return y * F.lit(unit) + F.lit(centre)


def slug_name(value: str) -> str:
    """The slug of a literal, at plan time; same rule as the column function."""
    out = "".join(c if c.isascii() and c.isalnum() else "_" for c in value.lower())
    return "_".join(p for p in out.split("_") if p)


def one_hot_list(df: DataFrame, column: str, values: Sequence[str], prefix: str) -> DataFrame:
    return df.withColumns(
        {
            f"{prefix}{slug_name(v)}": F.coalesce(F.col(column).cast("string") == v, F.lit(False)).cast("double")
            for v in values
        }
    )


def log_features(df: DataFrame, log: Mapping[str, str], log1p: Mapping[str, str]) -> DataFrame:
    cols = {out: F.log(F.col(c).cast("double")) for out, c in log.items()}
    cols |= {out: F.log1p(F.col(c).cast("double")) for out, c in log1p.items()}
    return df.withColumns(cols)


def context_concat(df: DataFrame, arm: str, stems: Sequence[str] = ("excerpt", "lede", "share_text")) -> Column:
    """Blank-joined context pieces the table has for this arm; null counts as empty."""
    present = [f"{s}_{arm}" for s in stems if f"{s}_{arm}" in df.columns]
    if not present:
        return F.lit("")
    return F.concat_ws(" ", *[T.text_or_empty(F.col(c)) for c in present])
