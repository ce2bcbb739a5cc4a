"""Headline queries at one scale; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores. Every query runs once to
warm up and once timed; the value is the sum of the timed runs.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from fewlabel.session import build_session

HEADLINE = (
    "reading_ease vocab_share structured_format prompt_coverage corpus_zipf tfidf clean_population population_split "
    "replication_split allocation_split leakage_audit gram ols if_weight_quantiles coef_summary candidate_summary "
    "spec_summary ppi_mean ppi_from_predictions scaling_curve power_law_fit rampup_replay allocation_cells "
    "oracle_allocation ridge_ifvar_exact surrogate_scaling embedding_screen budget_best stream_ppi_mean"
).split()


def run(fn, spark, sf: str) -> float:
    started = time.perf_counter()
    fn(spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = build_session("bench", cores=cpus, memory=os.environ.get("BENCH_MEMORY", "5g"))
    spark.conf.set("spark.sql.shuffle.partitions", str(max(8, int(cpus) if cpus.isdigit() else 8)))
    spark.sparkContext.setLogLevel("ERROR")
    from fewlabel.queries import QUERIES

    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        run(QUERIES[name], spark, sf)
        seconds[name] = round(run(QUERIES[name], spark, sf), 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(sf).name}))


if __name__ == "__main__":
    main()
