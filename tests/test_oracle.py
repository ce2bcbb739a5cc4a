"""A share of the registered queries against DuckDB on the smallest tables."""

import importlib.util
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"
NAMES = (
    "reading_ease curiosity_style structured_format prompt_coverage clean_population zscore arm_delta response_delta "
    "feature_kind eb_logit_ctr_diff population_split frac_split group_split distinct_texts gram ols if_weight coef_summary "
    "ci_by_budget rank_targets spec_summary candidate_diagnostics_lines feature_family family_kind_counts text_feature_family "
    "corpus_zipf tfidf budget_best budget_threshold ppi_mean select_checkpoint stream_ppi_mean kfold_assign"
).split()

spec = importlib.util.spec_from_file_location("check_queries", ROOT / "tools" / "check_queries.py")
check = importlib.util.module_from_spec(spec)
spec.loader.exec_module(check)


@pytest.fixture(scope="module")
def con():
    if not Path(SF).exists():
        pytest.skip("test tables are not here")
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    from fewlabel.queries import ORACLES, QUERIES

    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(check.canon(r[c]) for c in cols) for r in df.collect())
    rel = con.execute(ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = sorted(tuple(check.canon(r[names.index(c)]) for c in cols) for r in rel.fetchall())
    assert got and got == want


def test_every_oracle_has_a_query():
    from fewlabel.queries import ORACLES, QUERIES

    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 140
