"""SimHash and line deduplication against brute force."""

import random
import re

import numpy as np
import xxhash

from fewlabel.llm import line_dedup, simhash
from fewlabel.llm.common import components

SPACE = "[\x20\x09-\x0d]"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def slow_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", lower(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_roots(values, near):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if near(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def test_fingerprints_equal_brute_force():
    for text in ["", "a", "A b\tc", "The É quick\x0bbrown fox  jumps over", "x " * 30, "a b c d e f"]:
        assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)
    assert simhash.fingerprint(None) == 0


def test_links_span_all_pairs_within_the_radius(spark):
    r = random.Random(5)
    values = {r.getrandbits(64) for _ in range(150)}
    for v in list(values)[:60]:  # neighbours at 1 to 6 bits, and chains
        for _ in range(2):
            for b in r.sample(range(64), r.randint(1, 6)):
                v ^= 1 << b
            values.add(v)
    centre = r.getrandbits(64)
    values |= {centre ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)}  # one large group
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    want = slow_roots(signed, lambda a, b: (a ^ b).bit_count() <= 4 if a >= 0 and b >= 0 else ((a ^ b) & (1 << 64) - 1).bit_count() <= 4)
    for checks in (8, 11):
        got = {x["node"]: x["root"] for x in components(simhash.links(fps, checks=checks)).collect()}
        assert {v: got.get(v, v) for v in signed} == want


def test_slices_of_a_large_bucket_find_the_same(monkeypatch):
    fp = np.array([0, 3, 1 << 40, (1 << 40) | 7, 12345678901], np.uint64)
    flips = simhash._flips(8, 2)
    change = np.zeros(5, np.int64)
    whole = simhash._meet(flips, change, fp)
    monkeypatch.setattr(simhash, "SORTED_VALUES", 200)
    parts = simhash._meet(flips, change, fp)
    assert [x.tolist() for x in whole] == [x.tolist() for x in parts]


def test_near_duplicates_and_kept_documents(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(9, base), (4, base), (2, base.replace("w7 ", "v7 ")), (5, "something else entirely here today"), (8, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    fps = {i: slow_fingerprint(t) for i, t in rows}
    for i, (hexed, component) in got.items():
        assert hexed == f"{fps[i]:016x}"
    roots = slow_roots(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    assert {i: c for i, (_, c) in got.items()} == roots
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()) == sorted(set(roots.values()))


def slow_lines(rows):
    def key(line):
        return lower(re.sub(f"^{SPACE}+|{SPACE}+$", "", line))

    owner = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                owner[key(line)] = min(i, owner.get(key(line), i))
    return {i: [x for x in (t or "").split("\n") if owner.get(key(x), i) == i or len(key(x)) < 10] for i, t in rows}


def test_lines_equal_brute_force(spark):
    r = random.Random(3)
    pool = ["A shared line of text", " a SHARED line of text\t", "short", "", "another repeated passage", "é" * 10, "é" * 9]
    rows = [(i, "\n".join(r.choice([*pool, f"own line number {i} {j}"]) for j in range(r.randint(0, 6)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for batches in (1, 5):
        got = {x["doc_id"]: x for x in line_dedup.dedup_lines(docs, batches=batches).collect()}
        for i, lines in slow_lines(rows).items():
            assert got[i]["text"] == "\n".join(lines)
            assert got[i]["n_dropped"] == len(dict(rows)[i].split("\n")) - len(lines)


def test_runs_are_compacted_and_disjoint(spark):
    runs = line_dedup.LineRuns(spark, buckets=2, fanout=2)
    for b in range(5):
        keys = [(h, h, 10 * b + h) for h in range(b, b + 4)]
        runs.add(spark.createDataFrame(keys, "h1 long, h2 long, doc_id long"))
    assert sorted(level for level, _ in runs.runs) == [0, 2]
    assert {r["h1"]: r["owner"] for r in runs.owners().collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 14, 5: 25, 6: 36, 7: 47}
    assert runs.owners().count() == 8
