"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fewlabel.llm import decontamination, html_extract, language_id, line_dedup, lm_score, mixing, quality_classifier, quality_rules, secret_scan, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = "fp row score kept size copies word h1 h2 line batch owner component_id tail spans lang_pred held_out grade __id item_id s cut rest before whole more key bucket id own keep place number dropped coverage n target".split()
LONG = " ".join(f"word{i % 997}" for i in range(60_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 10),
    (2, None, "en", "a", None),
    (3, "", None, "b", 0),
    (4, " \t\n ", "de", None, 4),
    (5, LONG, "en", "a", len(LONG)),
    (6, "12 34 !!", "fr", "b", 8),
    (7, "The quick brown fox jumps over the lazy dog near the river bank today", "en", None, 10),
    (7, "The quick brown fox jumps over the lazy dog near the river bank today", "en", None, 10),
    (None, "no id here, password=hunter2secret", "en", "a", 1),
    (None, None, None, None, None),
]
BENCH = [(1, "the quick brown fox jumps over the lazy dog near the river bank today"), (2, None), (None, "one two three four five six"), (3, "tiny")]
LABELS = [(1, 1, 0), (5, 0, 0), (6, None, 1), (7, 1, None), (7, 0, 0), (None, 1, 0), (2, None, None)]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    docs = docs.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASHES) if c not in docs.columns])
    return docs, spark.createDataFrame(BENCH, "item_id long, text string"), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


RUNS = {
    "op1": lambda d, b, q: simhash.near_duplicates(d),
    "op2": lambda d, b, q: decontamination.contaminated(d, b),
    "op4": lambda d, b, q: language_id.predict(d),
    "op5": lambda d, b, q: quality_classifier.classify(d, q),
    "op6": lambda d, b, q: secret_scan.find_secrets(d),
    "op7": lambda d, b, q: lm_score.score_documents(d),
    "op8": lambda d, b, q: quality_rules.quality_rules(d),
    "op9": lambda d, b, q: mixing.mix_documents(d),
    "op10": lambda d, b, q: line_dedup.dedup_lines(d),
}


@pytest.mark.parametrize("name", RUNS)
def test_edge_rows(tables, name):
    rows = RUNS[name](*tables).collect()
    assert len(rows) == (5 if name == "op2" else len(ROWS)) or name == "op2"
    by_id = {r["doc_id"]: r for r in rows}
    if name == "op1":
        assert by_id[7]["component_id"] == 1 and by_id[2]["component_id"] == by_id[3]["component_id"] == by_id[4]["component_id"] == 2
        assert by_id[2]["fingerprint"] == "0" * 16 and all(r["component_id"] == 2 for r in rows if r["doc_id"] is None and r["fingerprint"] == "0" * 16)
    if name == "op2":
        assert sorted((r["doc_id"], r["item_id"]) for r in rows) == [(1, 1), (7, 1), (7, 1)]
    if name == "op4":
        assert by_id[2]["lang_pred"] == by_id[3]["lang_pred"] == by_id[6]["lang_pred"] == "und" and by_id[5]["lang_pred"] == "en"
    if name == "op5":
        assert not by_id[2]["kept"] and not by_id[4]["kept"] and by_id[3]["tail_probability"] == 0
    if name == "op6":
        assert by_id[2]["spans"] == "" and sorted(r["n_assign"] for r in rows if r["doc_id"] is None) == [0, 1]
    if name == "op7":
        assert by_id[2]["n_tokens"] == by_id[3]["n_tokens"] == 1 and by_id[5]["n_tokens"] == 60_001
    if name == "op8":
        assert by_id[2]["n_words"] == 0 and not by_id[2]["kept"] and by_id[5]["n_words"] == 60_000 and by_id[5]["base_failed"]
    if name == "op9":
        assert by_id[2]["taken"] == 0 and all(r["taken"] <= 3 * r["size"] for r in rows)
    if name == "op10":
        assert by_id[2]["n_lines"] == 1 and by_id[7]["n_dropped"] == 1 and by_id[1]["n_dropped"] == 0 and by_id[4]["n_lines"] == 2
        assert "owner" in rows[0].asDict()


@pytest.mark.parametrize("name", RUNS)
def test_empty_tables(tables, name):
    docs, bench, labels = tables
    assert RUNS[name](docs.where("false"), bench.where("false"), labels.where("false")).count() == 0


def test_nothing_to_learn_from(tables):
    docs, bench, labels = tables
    few = docs.where("doc_id = 1")
    assert quality_classifier.classify(few, labels.where("false")).count() == 1
    assert decontamination.contaminated(few, bench.where("false")).count() == 0
    assert language_id.predict(few.withColumn("lang", F.lit(None).cast("string"))).first()["lang_pred"] == "und"


def test_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<article><p>a  b<p>c</article>"), (None, "u", "<p>x"), (3, "u", "<article><p>a  b<p>c</article>"), (4, "u", "<<<>>&amp;&#x41;")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_extract.extract_pages(pages).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert {r["text"] for r in got if r["page_id"] in (1, 2)} == {""}
    assert html_extract.extract_pages(pages.where("false")).count() == 0


def test_stages_keep_columns(spark, tables, tmp_path):
    docs, bench, labels = tables
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for given in (docs, docs.where("false")):
            got = stage(spark, given, str(tmp_path))
            if name != corpus_pipeline.STAGES[-1][0]:
                assert got.columns == docs.columns, name
            got.collect()
