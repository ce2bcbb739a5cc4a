"""Periodic runs against the definition, word by word."""

import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from fewlabel.llm import periodic_runs as R
from fewlabel.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def runs_slowly(words, least=24, exponent=3):
    found, n = set(), len(words)
    for q in range(1, n // exponent + 1):
        start = 0
        while start + q < n:
            end = start + q
            while end < n and words[end] == words[end - q]:
                end += 1
            if end - start >= max(least, exponent * q):
                run = words[start:end]
                smallest = next(p for p in range(1, q + 1) if all(run[i] == run[i - p] for i in range(p, len(run))))
                if smallest == q:
                    found.add((start, end - start, q))
            start = end - q + 1
    return sorted(found)


@pytest.mark.parametrize("seed", range(12))
def test_equals_definition(seed):
    pick = random.Random(seed)
    for _ in range(25):
        words = []
        while len(words) < pick.choice([5, 40, 120, 300]):
            block = [pick.choice("ab" if pick.random() < 0.5 else "abcdefgh").encode() for _ in range(pick.randint(1, 12))]
            words += block * pick.choice([1, 1, 2, 3, 4, 9, 20])
        assert R.find_runs(words) == runs_slowly(words)
        assert R.find_runs(words, 6, 2) == runs_slowly(words, 6, 2)


def test_known_shapes():
    a, b = [b"a"] * 5000, [b"x", b"y", b"z"] * 8
    assert R.find_runs(a) == [(0, 5000, 1)]
    assert R.find_runs(b) == [(0, 24, 3)] and R.find_runs(b[:-1]) == []
    assert R.collapsed(b + [b"end"], [(0, 24, 3)]) == b"x y z end"
    # two runs of one period beside each other
    two = [b"p", b"q"] * 12 + [b"q", b"p"] * 12
    assert R.find_runs(two) == runs_slowly(two)


def test_long_text_in_time():
    words = [b"%d" % (i % 700) for i in range(60_000)]
    assert R.find_runs(words) == [(0, 60_000, 700)]


def changed(doc_id, words):
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    words = changed(doc_id, (text or "").encode().split())
    runs = runs_slowly(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    listing = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    milli = best[1] * 1000 // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, hashlib.sha256(listing.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {tuple(r) for r in QUERIES["op12_periodic_runs"](spark, SF).collect()}
    assert got == {expected(r["doc_id"], r["text"]) for r in docs} and sum(r[1] > 0 for r in got) > 5


def test_edges(spark):
    loop = " ".join(["one two three", "four"] * 20)
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, loop), (5, loop), (5, loop), (6, "w " * 30000)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, collapsed int, `a.b` string")
    found = R.periodic_runs(docs)
    assert set(found.columns) == {"doc_id", "text", "a.b", "run_start", "run_length", "run_period", "collapsed"}
    plain = [tuple(r) for r in R.digests(R.periodic_runs(R.planted(docs))).collect()]
    short = [r for r in plain if r[0] != 6]
    assert sorted(short, key=repr) == sorted((expected(i, t) for i, t in rows[:-1]), key=repr)
    assert next(r for r in plain if r[0] == 6)[1:5] == (1, 0, 30000, 1)
    assert R.digests(R.periodic_runs(R.planted(docs.limit(0)))).count() == 0
