"""Overlap of paired documents: each pair is compared once, for both of its rows."""

from fewlabel.queries import QUERIES

DOCS = [
    (0, "Red fox jumps"), (1, "red fox sleeps, red fox"),
    (2, "plum tree"), (2, "plum 42 jam"), (3, "Plum!"),
    (-2, "green hill"), (-1, "hill"),
    (4, ""), (5, "oak"),
    (6, None), (7, "elm"),
    (8, "alone"), (None, "nobody"),
]


def test_pairs_are_compared_once(spark, tmp_path):
    spark.createDataFrame(DOCS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for name in ("context_jaccard", "context_coverage", "prompt_coverage"):
        df = QUERIES[name](spark, str(tmp_path))
        # one comparison gives both rows of a pair, so that no text is read for words or moved twice
        assert "Generate explode(array(struct" in df._jdf.queryExecution().executedPlan().toString()
        got[name] = sorted(map(tuple, df.collect()), key=repr)
    third, half = 0.333333, 0.5
    jaccard = [(0, half), (1, half), (2, half), (2, half), (3, half), (3, half), (-2, half), (-1, half), (4, 0.0), (5, 0.0), (6, 0.0), (7, 0.0)]
    assert got["context_jaccard"] == sorted(jaccard, key=repr)
    coverage = [(0, 0.666667), (1, 0.666667), (2, half), (2, half), (3, 1.0), (3, 1.0), (-2, half), (-1, 1.0), (4, 0.0), (5, 0.0), (6, 0.0), (7, None)]
    assert got["context_coverage"] == sorted(coverage, key=repr)
    prompt = [r if r != (2, half) else None for r in coverage]
    prompt = [r for r in prompt if r] + [(2, half), (2, third)]
    assert got["prompt_coverage"] == sorted(prompt, key=repr)
