"""Tilings, quality rules, mixing and the pipeline against brute force and SQL."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from fewlabel.llm import decontamination, mixing, quality_rules
from fewlabel.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def slow_tiles(a, b, least):
    """Greedy tiling as defined: the longest unmarked match first, the first of equals."""
    free_a, free_b, out = [True] * len(a), [True] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and free_a[i + k] and free_b[j + k]:
                    k += 1
                if k > best[2]:
                    best = (i, j, k)
        if best[2] < least:
            return sorted(out)
        i, j, k = best
        free_a[i : i + k] = free_b[j : j + k] = [False] * k
        out.append(best)


def test_tiling_equals_brute_force():
    r = random.Random(8)
    for _ in range(60):
        b = [r.randint(1, 6) for _ in range(r.randint(3, 30))]
        cut = r.randint(0, len(b))
        a = [r.randint(1, 6) for _ in range(r.randint(0, 20))] + b[cut:] + [9] * r.randint(0, 2) + b[:cut]
        got = decontamination.tiles(np.array(a, np.uint64), np.array(b, np.uint64), least=3, first=4)
        want = slow_tiles(a, b, 3)
        assert sum(k for _, _, k in got) == sum(k for _, _, k in want) or sorted(k for *_, k in got) == sorted(k for *_, k in want)
        for i, j, k in got:
            assert a[i : i + k] == b[j : j + k] and k >= 3
        assert len({x for i, _, k in got for x in range(i, i + k)}) == len({x for _, j, k in got for x in range(j, j + k)}) == sum(k for *_, k in got)


def test_rolling_hashes_are_those_of_the_windows():
    seq = np.array([5, 7, 5, 7, 5, 9], np.uint64)
    h = decontamination.rolling(seq, 2)
    assert h[0] == h[2] and h[1] == h[3] and len(set(h.tolist())) == 3 and len(decontamination.rolling(seq, 7)) == 0


def test_reordered_passages_are_found(spark):
    words = [f"word{i}" for i in range(40)]
    item = " ".join(words)
    turned = " ".join(words[20:] + ["between"] + words[:20]).title() + "."
    half = " ".join(words[:20])
    rows = [(1, "before " + turned + " after"), (2, half), (3, "nothing shared at all in this one"), (4, None), (5, ("x " * 5000) + item)]
    got = decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"], r["n_tiles"]) for r in got.collect()} == {(1, 7, 2), (5, 7, 1)}
    kept = decontamination.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4]


def slow_counts(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = quality_rules.quality_rules(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(got) == len(texts)
    for r in got:
        want = slow_counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r["base_failed"] and r["kept"])
    assert sum(r["kept"] for r in got) > 0.9 * sum(not r["base_failed"] for r in got)


def test_rules_adapt_to_the_source(spark):
    clean = " ".join(f"w{i}" for i in range(60))
    loud = clean + " " + "#### " * 3
    rows = [(i, clean, "en", "plain") for i in range(50)] + [(100 + i, loud, "en", "loud") for i in range(50)] + [(200, clean + " #" * 40, "en", "plain")]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(50)) and all(got[100 + i] for i in range(50)) and not got[200]


def test_each_measure_rejects_a_planted_text(spark):
    def text(i, n=60, size=5):
        return "\n".join(" ".join(f"{i}x{t}y{k}".ljust(size + i % 2, "z") for k in range(10)) for t in range(n // 10))

    plain = [text(i, 60 + i % 3 * 10, 8) for i in range(297)]
    words = text(901, 60, 8)
    planted = {
        "symbol_share": text(902, 60, 8) + "#" * 15,
        "dup_line_share": "\n".join([*text(907, 70, 8).split("\n")[:4], "a1 b2", "a1 b2"]) + "\n" + " ".join(f"u{k}vvvvvv" for k in range(30)),
        "repeat_share": words + " " + " ".join(words.split()[3:13]),
        "n_words": text(903, 400, 8),
        "few words": text(904, 50, 8),
        "mean_word_length": text(905, 60, 30),
        "short words": " ".join(f"{k}" for k in range(60)),
    }
    rows = [(i, t, "en", "s") for i, t in enumerate([*plain, *planted.values()])]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert [n for i, n in enumerate(planted, len(plain)) if got[i]["base_failed"] or got[i]["kept"]] == []
    assert all(got[i]["kept"] for i in range(len(plain)))


def slow_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    held, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in held]
        level = (total - sum(held.values())) / sum(weight[s] for s in free) if free else 0
        above = [s for s in free if level * weight[s] > most * sizes[s]]
        if not above:
            return {**held, **{s: level * weight[s] for s in free}}
        held |= {s: most * sizes[s] for s in above}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, None: 40}, {"a": 1}, {"é": 7, "z": 7, "A": 0}, {str(i): i * i for i in range(12)}])
def test_water_filling_equals_brute_force(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
    assert got == pytest.approx(slow_targets(sizes))


def test_taken_words_come_near_the_targets(spark):
    r = random.Random(6)
    rows = [(i, r.choice("aabc"), r.randint(0, 40)) for i in range(800)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long")).collect()
    again = mixing.mix(spark.createDataFrame(rows[::-1], "doc_id long, source string, size long")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    for source in "abc":
        own = [x for x in got if x["source"] == source]
        assert abs(sum(x["taken"] for x in own) - own[0]["target"]) <= 20.5
        assert all(x["taken"] <= 3 * x["size"] for x in own)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = QUERIES[name](spark, SF)
    rel = con.execute(ORACLES[name])
    columns = [d[0] for d in rel.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(rel.fetchall())


def test_pipeline_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts, ids = [], {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        now = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert set(now) <= ids and len(now) == len(set(now))
        ids = set(now)
        counts.append(len(now))
    assert counts == sorted(counts, reverse=True) and counts[-1] > 20
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == ids
