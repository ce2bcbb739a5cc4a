"""Writers; Spark's commit protocol makes each of them all or nothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """csv, json, jsonl, jsonl.gz or parquet by suffix."""
    lower = path.lower()
    writer = df.write.mode(mode)
    if lower.endswith(".csv"):
        writer.option("header", True).csv(path)
    elif lower.endswith(".jsonl.gz"):
        writer.option("compression", "gzip").json(path)
    elif lower.endswith((".json", ".jsonl")):
        writer.json(path)
    elif lower.endswith(".parquet"):
        writer.parquet(path)
    else:
        raise ValueError(f"unsupported sink format: {path}")


PREDICTION_COLUMNS = ("sample_id", "pred_scaled", "pred_raw")


def write_predictions(df: DataFrame, path: str, cell: str = "cell", unlabelled: bool = False) -> None:
    """Predictions partitioned by cell; the unlabelled pool keeps three columns only."""
    out = df.select(cell, *PREDICTION_COLUMNS) if unlabelled else df
    out.write.mode("overwrite").partitionBy(cell).parquet(path)


def write_metrics_json(df: DataFrame, path: str, nested: dict[str, Sequence[str]]) -> None:
    """One JSON object per cell; the named groups of columns become nested objects."""
    inner = {c for cols in nested.values() for c in cols}
    flat = [c for c in df.columns if c not in inner]
    df.select(*flat, *[F.struct(*cols).alias(name) for name, cols in nested.items()]).write.mode(
        "overwrite"
    ).json(path)


def round_report(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(
        *[F.round(f.name, digits).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in df.schema.fields]
    )
