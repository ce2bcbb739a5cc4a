"""Choosing the epoch to keep from a training history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def select_checkpoint(
    history: DataFrame, keys: Sequence[str], epoch: str, metric: str, min_delta: float = 0.0, min_epochs: int = 1, patience: int = 3
) -> DataFrame:
    """Best epoch before the early stop.

    An epoch improves when it beats the running best by more than min_delta.
    Training stops at the first epoch from min_epochs on with ``patience``
    epochs since the last improvement. With min_delta > 0 the running best is
    that of the improving epochs, which a fold over the short, ordered history
    of a cell computes. Epochs without a metric improve only as long as there
    is no best; a cell without any has no best epoch.
    """
    per = history.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(epoch).alias("e"), F.col(metric).cast("double").alias("m")))).alias("h"))
    start = F.struct(
        F.lit(None).cast("double").alias("best"),
        F.lit(None).cast("long").alias("best_epoch"),
        F.lit(0).cast("long").alias("waited"),
        F.lit(None).cast("long").alias("stop"),
        F.lit(0).cast("long").alias("last"),
    )

    def step(acc, row):
        done = acc["stop"].isNotNull()
        better = acc["best"].isNull() | (row["m"] < acc["best"] - F.lit(min_delta))
        waited = F.when(better, F.lit(0).cast("long")).otherwise(acc["waited"] + 1)
        halt = (row["e"] >= min_epochs) & (waited >= patience)
        return F.struct(
            F.when(done, acc["best"]).otherwise(F.when(better, row["m"]).otherwise(acc["best"])).alias("best"),
            F.when(done, acc["best_epoch"]).otherwise(F.when(better, row["e"].cast("long")).otherwise(acc["best_epoch"])).alias("best_epoch"),
            F.when(done, acc["waited"]).otherwise(waited).alias("waited"),
            F.when(done, acc["stop"]).otherwise(F.when(halt, row["e"].cast("long"))).alias("stop"),
            F.when(done, acc["last"]).otherwise(row["e"].cast("long")).alias("last"),
        )

    folded = per.withColumn("r", F.aggregate("h", start, step))
    return folded.select(
        *keys,
        F.col("r.last").alias("epochs_trained"),
        F.col("r.stop").isNotNull().alias("early_stopped"),
        F.when(F.col("r.best").isNotNull(), F.col("r.best_epoch")).alias("best_epoch"),
        F.col("r.best").alias("best_metric"),
    )
