"""Linear surrogates: ridge paths from moments, batch scoring."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources.tables import child_names
from .moments import Moments


def ridge_from_moments(m: Moments, xs: Sequence[str], y: str, alpha: float) -> np.ndarray:
    """Ridge with a free intercept: (C + alpha I) b = c on centred sums."""
    cols = list(xs)
    s1 = m.block(["1"], cols)[0]
    c = m.block(cols, cols) - np.outer(s1, s1) / m.weight
    cy = m.block(cols, [y])[:, 0] - s1 * m.block(["1"], [y])[0, 0] / m.weight
    b = np.linalg.solve(c + alpha * np.eye(len(cols)), cy) if alpha > 0 else np.linalg.pinv(c) @ cy
    return np.append((m.block(["1"], [y])[0, 0] - s1 @ b) / m.weight, b)


def mse_of(beta: np.ndarray, m: Moments, xs: Sequence[str], y: str) -> float:
    z = ["1", *xs, y]
    b = np.append(-beta, 1.0)
    return float(b @ m.block(z, z) @ b / m.weight)


def ifvar_of(beta: np.ndarray, squared: Moments, first: Moments, xs: Sequence[str], y: str, ddof: int) -> float:
    """Var(a (y - f)) from sums of a^2 z z' and a z; no row is scored."""
    z = ["1", *xs, y]
    b = np.append(-beta, 1.0)
    n = squared.n
    mean = float(first.block(["1"], z)[0] @ b / n)
    square = float(b @ squared.block(z, z) @ b / n)
    return max(square - mean * mean, 0.0) * n / (n - ddof)


def ridge_path(
    train: Moments,
    validation: Moments,
    xs: Sequence[str],
    y: str,
    alphas: Sequence[float],
    squared: Moments | None = None,
    first: Moments | None = None,
    ddof: int = 1,
) -> tuple[np.ndarray, float, float, float | None]:
    """Best alpha by validation MSE, or by IF variance when its moments are given.

    Strictly smaller wins, so the first alpha keeps a tie.
    """
    best = None
    for alpha in alphas:
        beta = ridge_from_moments(train, xs, y, alpha)
        mse = mse_of(beta, validation, xs, y)
        ifvar = ifvar_of(beta, squared, first, xs, y, ddof) if squared is not None else None
        score = mse if ifvar is None else ifvar
        if best is None or score < best[0]:
            best = (score, beta, float(alpha), mse, ifvar)
    return best[1:]


def ridge_ifvar_exact(train_aug: Moments, xs: Sequence[str], alpha: float) -> np.ndarray:
    """Minimiser of the sample IF variance: design a (1, x), outcome a y, free centring.

    ``train_aug`` holds moments of the columns a, a*x (named a_x) and a*y (named a_y).
    """
    aug = ["a", *[f"a_{x}" for x in xs]]
    return ridge_from_moments(train_aug, aug, "a_y", alpha)[1:]


def augmented(df: DataFrame, a: str, xs: Sequence[str], y: str) -> DataFrame:
    return df.withColumns({f"a_{x}": F.col(a) * F.col(x) for x in xs} | {"a_y": F.col(a) * F.col(y)})


def score_linear(vector: str, coef: Sequence[float]) -> Column:
    """intercept + sum of coef * x over an array column."""
    weights = F.array(*[F.lit(float(c)) for c in coef[1:]])
    return F.lit(float(coef[0])) + F.aggregate(
        F.zip_with(F.col(vector), weights, lambda x, w: x.cast("double") * w), F.lit(0.0), lambda s, v: s + v
    )


HELD_HASHES = 500_000  # of texts that a task remembers to have scored


def batch_score(
    df: DataFrame,
    text: str,
    fn: Callable[[pd.Series], pd.Series],
    out: str = "score",
    kind: str = "double",
    batch: int | None = None,
    store: str | None = None,
) -> DataFrame:
    """Apply a model to texts in Arrow batches; results are kept in a store by the hash of the text.

    ``fn`` gets a series of texts and returns as many values, the same for the
    same text. Texts the store knows are left out by an anti join on the hash;
    the others are scored where they are read, each once per task, and their
    results (hash and value, no text) are appended to the folder ``store``,
    which later calls go on with. Without ``store`` a new folder is used.
    ``batch`` cuts an Arrow batch into smaller model batches. A null text gets
    no value.
    """
    spark = df.sparkSession
    folder = store or os.path.join(shared_dir(spark), f"scores-{uuid.uuid4().hex}")
    schema = f"__h string, {out} {kind}"
    keyed = df.withColumn("__h", F.sha2(F.col(text), 256))
    fresh = keyed.where(F.col(text).isNotNull()).select("__h", F.col(text).alias("__t"))
    if child_names(spark, folder):
        fresh = fresh.join(spark.read.schema(schema).parquet(folder).select("__h"), "__h", "left_anti")

    def run(batches: Iterable[pd.DataFrame]):
        seen: set[str] = set()
        for pdf in batches:
            if len(seen) > HELD_HASHES:
                seen.clear()
            new = pdf[~pdf["__h"].isin(seen)].drop_duplicates("__h")
            seen.update(new["__h"])
            step = batch or max(len(new), 1)
            for i in range(0, len(new), step):
                part = new.iloc[i : i + step]
                yield pd.DataFrame({"__h": part["__h"].to_numpy(), out: list(fn(part["__t"]))})

    fresh.mapInPandas(run, schema).write.mode("append").parquet(folder)
    scores = spark.read.schema(schema).parquet(folder).groupBy("__h").agg(F.max(out).alias(out))
    return keyed.join(scores, "__h", "left").drop("__h")


def constant_surrogate(df: DataFrame, y: str, on: Column, out: str = "pred") -> DataFrame:
    """The mean outcome of the chosen rows, as the prediction of every row."""
    mean = df.where(on).agg(F.avg(y).alias("m")).scalar()
    return df.withColumn(out, mean)
