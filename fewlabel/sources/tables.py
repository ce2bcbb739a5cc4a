"""Table readers chosen by suffix, with column guards."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Read csv, json, jsonl, jsonl.gz or parquet by suffix; the scan's own splits deal out the rows."""
    lower = path.lower().rstrip("/")
    reader = spark.read if schema is None else spark.read.schema(schema)
    if lower.endswith(".csv"):
        df = reader.csv(path, header=True, inferSchema=schema is None)
    elif lower.endswith((".jsonl", ".jsonl.gz")):
        df = reader.json(path)
    elif lower.endswith(".json"):
        # one file is a JSON document; a folder is what Spark writes, one row per line
        df = reader.option("multiLine", not is_folder(spark, path)).json(path)
    elif lower.endswith(".parquet"):
        df = reader.parquet(path)
    else:
        raise ValueError(f"unsupported source format: {path}")
    return df


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def filter_split_limit(
    df: DataFrame, split: str | None = None, max_rows: int | None = None, order_by: Sequence[str] = ()
) -> DataFrame:
    """Optional split filter, then the first ``max_rows`` rows of the given order."""
    if split is not None and split != "all":
        require_columns(df, ["split"])
        df = df.where(F.col("split") == split)
    if max_rows is not None:
        if not order_by:
            raise ValueError("max_rows needs order_by: a table has no row order of its own")
        df = df.orderBy(*order_by).limit(max_rows)
    return df


def read_embeddings(
    spark: SparkSession, path: str, vectors: Sequence[str] = ("embedding",), dim: int | None = None
) -> DataFrame:
    """Vectors keyed by id; a vector of another length than ``dim`` stops the job."""
    df = require_columns(read_table(spark, path), vectors)
    if dim is not None:
        for v in vectors:
            df = df.withColumn(
                v,
                F.when(F.size(v) == dim, F.col(v)).otherwise(
                    F.raise_error(F.lit(f"column {v}: vector length differs from {dim}"))
                ),
            )
    return df


def _file_system(spark: SparkSession, path: str):
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, hpath = _file_system(spark, path)
    return fs.exists(hpath)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, hpath = _file_system(spark, path)
    return fs.exists(hpath) and fs.getFileStatus(hpath).isDirectory()


def child_names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies directly in a folder, by Spark's own file system."""
    fs, hpath = _file_system(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(hpath)] if fs.exists(hpath) else []


# Result layouts in the order they are looked for, and the
# candidate value columns with the factor to the raw 80-100 scale (5 squared).
RESULT_LAYOUTS = (
    "training_runtime_summary.csv",
    "loss_comparison_residual_variance_from_log.csv",
    "loss_comparison_summary.csv",
)
VALUE_COLUMNS = {
    "validation_scale": (
        ("validation_scale_residual_var_raw", 1.0),
        ("validation_scale_residual_var", 25.0),
        ("validation_residual_var_raw", 1.0),
        ("validation_residual_var", 25.0),
    ),
    "validation_stop": (
        ("validation_stop_residual_var_raw", 1.0),
        ("validation_stop_residual_var", 25.0),
    ),
}


def resolve_value_column(df: DataFrame, value: str = "auto") -> tuple[Column, str]:
    """First candidate column the table has, times its factor; and its family."""
    if value != "auto" and value not in VALUE_COLUMNS:
        raise ValueError(f"unknown value family: {value}")
    families = list(VALUE_COLUMNS) if value == "auto" else [value]
    for family in families:
        for name, factor in VALUE_COLUMNS[family]:
            if name in df.columns:
                return F.col(name).cast("double") * F.lit(factor), family
    raise ValueError("no residual-variance column found")


def read_first_available(
    spark: SparkSession, folder: str, value: str = "auto", known_methods: Sequence[str] = ()
) -> DataFrame:
    """First result layout present, as (method, replication_id, s_train, residual_var_raw)."""
    for layout in RESULT_LAYOUTS:
        path = f"{folder.rstrip('/')}/{layout}"
        if not path_exists(spark, path):
            continue
        raw = read_table(spark, path)
        has = set(raw.columns)
        value_col, _ = resolve_value_column(raw, value)
        method = next((c for c in ("method", "loss") if c in has), None)
        if layout == RESULT_LAYOUTS[0]:
            method = "loss" if "loss" in has else None
        if layout == RESULT_LAYOUTS[2] and known_methods:
            raw = raw.where(F.col("loss").isin(*known_methods))
        replicated = layout == RESULT_LAYOUTS[0] and "replication_id" in has
        return raw.select(
            (F.col(method) if method else F.lit("var")).cast("string").alias("method"),
            (F.col("replication_id") if replicated else F.lit(None)).cast("long").alias("replication_id"),
            F.col("s_train").cast("long").alias("s_train"),
            value_col.alias("residual_var_raw"),
        )
    raise FileNotFoundError(f"no result layout found in {folder}")


def python_round(x: float) -> int:
    """Rounding of halves to even, as the budget arithmetic needs it."""
    floor = math.floor(x)
    diff = x - floor
    if diff > 0.5 or (diff == 0.5 and floor % 2 == 1):
        return floor + 1
    return floor
