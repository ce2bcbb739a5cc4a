"""Cell results: nested JSON objects to flat rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Field names of a cell result; absent ones take the defaults.
CELL_JSON = """
  method string, budget long, replication long, rho double, allocation_source string, validation_size long, n_eff long,
  s_train long, correction_size long, unlabeled_size long, ppi_ci_low double, ppi_ci_high double,
  sample_mean_ci_low double, sample_mean_ci_high double,
  ppi struct<target_mean: double, mu_hat_ppi: double, ppi_error: double, correction_residual_var: double,
    unlabeled_prediction_var: double, ppi_var_est: double, ppi_covered: boolean, sample_mean: double,
    sample_mean_var_est: double, sample_mean_error: double, sample_mean_covered: boolean>,
  validation struct<validation_residual_var: double, validation_rmse: double, validation_corr: double>,
  runtime struct<runtime_seconds: double, epochs_trained: long, best_epoch: long, early_stopped: boolean,
    oom_fallback_used: boolean, device: string>
"""
DEFAULTS = {
    "allocation_source": "grid",
    "runtime_seconds": 0.0,
    "epochs_trained": 0,
    "best_epoch": 0,
    "early_stopped": False,
    "oom_fallback_used": False,
    "device": "",
}


def flatten_cells(raw: DataFrame) -> DataFrame:
    flat = [c for c in raw.columns if c not in ("ppi", "validation", "runtime")]
    out = raw.select(*flat, "ppi.*", "validation.*", "runtime.*")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in DEFAULTS.items()})


def read_cell_metrics(spark: SparkSession, path: str) -> DataFrame:
    """All cell files below a path or glob; a fixed schema, so no inference pass."""
    return flatten_cells(spark.read.schema(CELL_JSON).json(path))
