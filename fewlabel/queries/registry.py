"""Named queries, each with the SQL an independent engine can check it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def shaped(df: DataFrame, keys: list[str], floats: list[str], digits: int = 6) -> DataFrame:
    """Key columns as they are, float columns rounded for comparison."""
    return df.select(*keys, *[rounded(F.col(c), digits).alias(c) for c in floats])


def rounded(col: Column, digits: int = 6) -> Column:
    return F.round(col.cast("double"), digits)


def sql_shaped(core: str, keys: list[str], floats: list[str], digits: int = 6, with_: str = "") -> str:
    """The SQL twin of :func:`shaped`; a zero never carries a sign."""
    cols = list(keys)
    for f in floats:
        v = f"round(CAST({f} AS DOUBLE), {digits})"
        cols.append(f"CASE WHEN {v} = 0 THEN 0.0::DOUBLE ELSE {v} END AS {f}")
    return f"{with_}\nSELECT {', '.join(cols)} FROM (\n{core}\n) AS core"
