"""Sums of products: the one statistic every linear fit here is made from.

A pass over the rows yields, per group, the matrix of sums z z' with
z = (1, features, y). Every regression on a subset of the features, every
correlation and every variance inflation is a sub-matrix of it, so a grid of
fits costs one scan. Only d x d numbers reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as ST

NATIVE_COLUMNS = 12  # wider designs use partial matrices per task
MAX_COLUMNS = 4096  # a d x d matrix must stay small on the driver


def gram(df: DataFrame, xs: Sequence[str], y: str | None, by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """Per group: n, the column names and the upper triangle of sums z z'."""
    names = ["1", *xs, *([y] if y else [])]
    if len(names) > NATIVE_COLUMNS:
        vec = F.array(*[F.lit(1.0) if c == "1" else F.col(c).cast("double") for c in names])
        return gram_vectors(df.select(*by, vec.alias("z"), (weight if weight is not None else F.lit(1.0)).alias("w")), len(names), by)
    z = [F.lit(1.0) if c == "1" else F.col(c).cast("double") for c in names]
    w = weight if weight is not None else F.lit(1.0)
    sums = [F.sum(w * z[i] * z[j]) for i in range(len(z)) for j in range(i, len(z))]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("zz"))


def gram_vectors(df: DataFrame, dim: int, by: Sequence[str] = ()) -> DataFrame:
    """The same for a design held in an array column ``z`` with weights ``w``.

    Instead of ``z`` the rows may carry a sparse design: columns idx, val and y,
    standing for (1, x_0 .. x_{dim-3}, y).

    Each task sorts its rows by group, adds up one matrix at a time with a
    matrix product per Arrow batch and group, and emits it row by row when its
    group ends: whatever the number of groups, it holds one matrix and emits one
    per group. The numbers are then added natively per (group, row, column).
    """
    if dim > MAX_COLUMNS:
        raise ValueError(f"{dim} columns exceed the {MAX_COLUMNS} a moment matrix may have")
    keys = list(by)
    key_fields = [df.schema[k] for k in keys]
    sparse = "z" not in df.columns
    part_schema = ST.StructType(
        key_fields
        + [ST.StructField("i", ST.IntegerType()), ST.StructField("n", ST.LongType()), ST.StructField("v", ST.ArrayType(ST.DoubleType()))]
    )

    def design(part: pd.DataFrame) -> np.ndarray:
        if not sparse:
            return np.stack(part["z"].to_numpy()).astype(float)
        z = np.zeros((len(part), dim))
        z[:, 0] = 1.0
        z[:, -1] = part["y"].to_numpy(dtype=float)
        for r, (i, v) in enumerate(zip(part["idx"], part["val"])):
            z[r, np.asarray(i, dtype=int) + 1] = v
        return z

    def partial(batches: Iterable[pd.DataFrame]):
        held, total, count = None, None, 0
        for pdf in batches:
            if pdf.empty:
                continue
            groups = pdf.groupby(keys, sort=False, dropna=False) if keys else [((), pdf)]
            for key, part in groups:
                key = key if isinstance(key, tuple) else (key,)
                z = design(part)
                m = z.T @ (z * part["w"].to_numpy(dtype=float)[:, None])
                same = held is not None and all(a == b or (pd.isna(a) and pd.isna(b)) for a, b in zip(key, held))
                if held is not None and not same:
                    yield emit(held, total, count)
                held, total, count = key, total + m if same else m, count + len(part) if same else len(part)
        if held is not None:
            yield emit(held, total, count)

    def emit(key: tuple, m: np.ndarray, count: int) -> pd.DataFrame:
        out = {k: [None if pd.isna(v) else v] * dim for k, v in zip(keys, key)}
        return pd.DataFrame({**out, "i": range(dim), "n": count, "v": [m[i, i:] for i in range(dim)]})

    rows = df.select(*keys, *(["idx", "val", "y"] if sparse else ["z"]), "w")
    # rows of a group come together, so a task holds one matrix and hands on one per group
    parts = (rows.sortWithinPartitions(*keys) if keys else rows).mapInPandas(partial, part_schema)
    # one number per (group, row, column) and task, added natively: partial sums before
    # and after the shuffle, so no task ever stacks the parts of all others
    cells = parts.select(*keys, "i", F.when(F.col("i") == 0, F.col("n")).alias("n"), F.posexplode("v").alias("j", "x"))
    sums = cells.groupBy(*keys, "i", "j").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "j", "x")))  # dim (dim + 1) / 2 numbers, bounded by MAX_COLUMNS
    return sums.groupBy(*keys).agg(F.max("n").alias("n"), F.transform(ordered, lambda r: r["x"]).alias("zz"))


@dataclass(frozen=True)
class Moments:
    names: tuple[str, ...]
    n: int
    m: np.ndarray

    def index(self, cols: Sequence[str]) -> list[int]:
        return [self.names.index(c) for c in cols]

    def block(self, rows: Sequence[str], cols: Sequence[str]) -> np.ndarray:
        return self.m[np.ix_(self.index(rows), self.index(cols))]

    @property
    def weight(self) -> float:
        return float(self.m[0, 0])

    def mean(self, c: str) -> float:
        return float(self.block(["1"], [c])[0, 0] / self.weight)

    def cov(self, a: str, b: str) -> float:
        return float(self.block([a], [b])[0, 0] / self.weight - self.mean(a) * self.mean(b))

    def corr(self, a: str, b: str) -> float:
        d = self.cov(a, a) * self.cov(b, b)
        return self.cov(a, b) / np.sqrt(d) if d > 0 else float("nan")

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.names, self.n + other.n, self.m + other.m)

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.names, self.n - other.n, self.m - other.m)


def unpack(zz: Sequence[float], dim: int) -> np.ndarray:
    m = np.zeros((dim, dim))
    m[np.triu_indices(dim)] = zz
    return m + np.triu(m, 1).T


def collect_moments(g: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> dict[tuple, Moments]:
    """Bring the matrices (never the rows) to the driver, keyed by group."""
    out = {}
    for r in g.toLocalIterator():
        out[tuple(r[k] for k in by)] = Moments(tuple(names), int(r["n"]), unpack(r["zz"], len(names)))
    return out


def moments_of(df: DataFrame, xs: Sequence[str], y: str | None, by: Sequence[str] = (), weight: Column | None = None) -> dict[tuple, Moments]:
    return collect_moments(gram(df, xs, y, by, weight), ["1", *xs, *([y] if y else [])], by)


# --- prefix moments for one feature, fully declarative ----------------------------


def prefix_sums(df: DataFrame, groups: Sequence[str], bucket: str, sums: dict[str, Column]) -> DataFrame:
    """Running sums over ordered buckets: every nested training size in one pass.

    Rows are first added up per (group, bucket); the running window then works
    on one small row per bucket.
    """
    per = df.groupBy(*groups, bucket).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    upto = W.partitionBy(*groups).orderBy(bucket).rowsBetween(W.unboundedPreceding, W.currentRow)
    return per.select(*groups, bucket, *[F.sum(n).over(upto).alias(n) for n in sums])


def xy_sums(x: Column, y: Column) -> dict[str, Column]:
    return {"n": F.lit(1.0), "sx": x, "sy": y, "sxx": x * x, "sxy": x * y, "syy": y * y}


def line_from_sums(n: Column, sx: Column, sy: Column, sxx: Column, sxy: Column) -> tuple[Column, Column]:
    """Intercept and slope; a flat feature gives the mean and slope 0."""
    vx = sxx - sx * sx / n
    slope = F.when(vx > 1e-9 * sxx, (sxy - sx * sy / n) / vx).otherwise(F.lit(0.0))
    return (sy - slope * sx) / n, slope
