"""Terms counted inside the row: the same numbers as by hand, without moving or sorting what is wide."""

import math
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fewlabel.operators import terms as TM
from fewlabel.plans import populations as POP


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def by_hand(docs, max_features, min_df):
    """(term, tf, df, idf) of the first terms, and the weights per id; rows of an id are one document without pairs across."""
    counts = {}
    for id_, words in docs:
        words = words or []
        counts.setdefault(id_, Counter()).update(words + [f"{a} {b}" for a, b in zip(words, words[1:])])
    tf, df = Counter(), Counter()
    for c in counts.values():
        tf.update(c)
        df.update(c.keys())
    top = sorted((t for t in tf if df[t] >= min_df), key=lambda t: (-tf[t], t))[:max_features]
    idf = {t: math.log((1 + len(docs)) / (1 + df[t])) + 1 for t in top}
    weights = {}
    for id_, c in counts.items():
        w = {t: c[t] * idf[t] for t in top if t in c}
        norm = math.sqrt(sum(x * x for x in w.values()))
        weights.update({(id_, t): x / norm for t, x in w.items()})
    return {t: (tf[t], df[t], pytest.approx(idf[t])) for t in top}, weights


DOCS = [
    (1, "a b a b c".split()),
    (2, "b a a a b".split()),
    (3, ["c", "b", "a"]),
    (4, []),
    (5, None),
    (6, "z a b".split()),
    (6, "c q a b".split()),
    (None, ["b", "c"]),
    (7, ["only"]),
    (8, "é a é a".split()),
]


@pytest.mark.parametrize("max_features,min_df", [(1, 1), (3, 2), (4, 1), (7, 2), (500, 1), (500, 3), (500, 99)])
def test_terms_by_hand(spark, max_features, min_df):
    counts = TM.term_counts(spark.createDataFrame(DOCS, "id long, w array<string>").repartition(3), "id", "w")
    vocab = TM.vocabulary(counts, len(DOCS), max_features, min_df)
    rows = vocab.orderBy("idx").collect()
    top, weights = by_hand(DOCS, max_features, min_df)
    assert {r["term"]: (r["tf"], r["df"], r["idf"]) for r in rows} == top
    assert [r["term"] for r in rows] == sorted(top) and [r["idx"] for r in rows] == list(range(len(top)))
    got = {}
    for r in TM.tfidf(counts, "id", vocab).collect():
        assert list(r["idx"]) == sorted(set(r["idx"]))
        got.update({(r["id"], rows[i]["term"]): v for i, v in zip(r["idx"], r["val"])})
    assert got == {k: pytest.approx(v) for k, v in weights.items()}


@pytest.mark.parametrize("at_once", [1, 2, 5, 1 << 20])
def test_batches_are_cut_between_rows(monkeypatch, at_once):
    monkeypatch.setattr(TM, "TOKENS_AT_ONCE", at_once)
    words = [["a", "b", "c"], [], None, ["d"], ["e", "f", "g", "h"], [], ["i"]]
    batch = pa.RecordBatch.from_pydict({"id": list(range(7)), "words": pa.array(words, pa.list_(pa.string()))})
    got = {i: [] for i in range(7)}
    for part, flat, row in TM._slices([batch]):
        assert len(flat) <= at_once or sum(len(w or []) > 0 for w in part.column("words").to_pylist()) == 1
        for w, r in zip(flat.to_pylist(), row):
            got[part.column("id")[int(r)].as_py()].append(w)
    assert got == {i: w or [] for i, w in enumerate(words)}


def test_weights_shuffle_nothing(spark):
    rows = spark.createDataFrame([(i, ["a", "b", f"w{i % 7}"]) for i in range(50)], "id long, w array<string>")
    counts = TM.term_counts(rows, "id", "w")
    weights = TM.tfidf(counts, "id", TM.vocabulary(counts, 50, 5, 2))
    assert "Exchange" not in plan(weights) and "Exchange" not in plan(counts)


def test_texts_are_not_sorted(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i // 2}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = POP.labelled_texts(docs, labels)
        last = plan(texts).split("ShuffledHashJoin")
        assert len(last) > 1 and "SortMergeJoin" not in last[0]
        got = texts.orderBy("id").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [(r["id"], r["text"], r["y"]) for r in got] == [(i, f"text {i // 2}", 0.0) for i in range(0, 30, 2)]


def test_surrogate_stores_no_terms_of_documents(spark, monkeypatch):
    """Stored tables of the pair surrogate have a row per document or word, never one per document and term."""
    from fewlabel.plans import headlines as H

    stored = {}

    def counted(df, name, keep=TM.materialise):
        out = keep(df, name)
        stored[name] = out.count()
        return out

    monkeypatch.setattr(TM, "materialise", counted)
    monkeypatch.setattr(H, "materialise", counted)
    rows = [(i, " ".join(f"w{(i + j) % 40}" for j in range(20)), float(i % 2), "h_scale" if i < 40 else "target") for i in range(60)]
    pred, info = H.tfidf_surrogate(spark.createDataFrame(rows, "id long, text string, y double, split string"), "id", "text", "y", max_features=30)
    assert pred.count() == 60 and info["tfidf_n_features"] == 30
    assert max(stored.values()) <= 60
