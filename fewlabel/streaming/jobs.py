"""Running results over arriving files, equal to their batch counterparts.

State is one row of sums per group (and one key per cell where copies are
dropped), so it does not grow with the stream. Each batch writes the groups it
has changed into a folder that also holds the query's checkpoint, and these are
merged by key: called again with the same folder, a job reads only what has
arrived since.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ppi import finish_ppi, ppi_sums
from ..session import shared_dir
from ..sources.metrics import CELL_JSON, flatten_cells
from ..sources.tables import child_names


def run_available(
    stream: DataFrame, name: str, keys: Sequence[str], finish: Callable[[DataFrame], DataFrame] | None = None, folder: str | None = None
) -> DataFrame:
    """Process everything that has arrived, in update mode, and return the result table, one row per ``keys``.

    A batch writes the groups it has changed, to a table named by its number: a
    batch that is run again after a failure replaces its own output only. The
    tables since the last merge are then merged by key, the highest batch
    number winning, into a table named by the last number; merging again gives
    the same table. ``folder`` keeps all this and the checkpoint for the next
    call; without it a new one below the shared folder is used once.
    """
    spark = stream.sparkSession
    folder = folder or os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")

    def save(batch: DataFrame, number: int) -> None:
        rows = finish(batch) if finish else batch
        rows.withColumn("__batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{folder}/changes-{number}")

    query = (
        stream.writeStream.outputMode("update")
        .foreachBatch(save)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return merge_changes(spark, folder, name, keys)


def merge_changes(spark: SparkSession, folder: str, name: str, keys: Sequence[str]) -> DataFrame:
    """Merges the changes since the last merge into it by key; see :func:`run_available`."""

    def numbers(kind: str) -> list[int]:
        return sorted(int(n.removeprefix(kind)) for n in child_names(spark, folder) if n.startswith(kind))

    merged, changes = numbers("merged-"), numbers("changes-")
    if not changes:
        raise RuntimeError(f"no input has arrived for {name}")
    since = merged[-1] if merged else -1
    new = [n for n in changes if n > since]
    if new:
        parts = [f"{folder}/changes-{n}" for n in new] + ([f"{folder}/merged-{since}"] if merged else [])
        rows = spark.read.parquet(*parts)
        newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), "__batch").alias("r")).select("r.*")
        since = new[-1]
        newest.write.mode("overwrite").parquet(f"{folder}/merged-{since}")
    return spark.read.parquet(f"{folder}/merged-{since}").drop("__batch")


def stream_ppi_mean(
    rows: DataFrame, by: Sequence[str], y: str, pred: str, correction: Column, unlabelled: Column, labelled: Column, unit: float = 1.0, folder: str | None = None
) -> DataFrame:
    """Corrected mean per group over a stream of labels and predictions."""
    return run_available(rows.groupBy(*by).agg(*ppi_sums(y, pred, correction, unlabelled, labelled, None)), "ppi", by, lambda s: finish_ppi(s, unit), folder)


def stream_cell_metrics(spark: SparkSession, path: str, files_per_batch: int = 4, folder: str | None = None) -> DataFrame:
    """Finished cells per method and size with running means; a cell counts once.

    The state of the duplicate check is one key per cell of the plan.
    """
    raw = spark.readStream.schema(CELL_JSON).option("maxFilesPerTrigger", files_per_batch).json(path)
    cells = flatten_cells(raw).dropDuplicates(["method", "budget", "replication", "rho", "allocation_source"])
    keys = ["method", "budget", "s_train"]
    running = cells.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("completed"),
        F.avg("ppi_var_est").alias("mean_var"),
        F.avg(F.try_divide(F.col("ppi_var_est"), F.col("sample_mean_var_est"))).alias("mean_ratio"),
        F.avg("validation_rmse").alias("mean_rmse"),
    )
    return run_available(running, "cells", keys, folder=folder)
