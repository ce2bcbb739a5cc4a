"""Hard negatives against plain integer arithmetic."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fewlabel.llm import hard_negatives as H


@pytest.mark.parametrize("dim,size", [(1, 9), (3, 1 << 20), (64, 300), (700, 5000), (2500, 80)])
def test_scores_are_exact(dim, size):
    made = np.random.default_rng(dim)
    a, b = (made.integers(-size, size + 1, (n, dim)) for n in (7, 11))
    a[0], b[0] = size, -size  # the extreme score
    bound = dim * size * size
    primes = H.primes_for(dim, bound)
    got = H.scores(H.residues(a, primes), H.residues(b, primes), primes)
    assert (got == a.astype(object) @ b.T.astype(object)).all()


def test_primes():
    primes = H.primes_for(64, 10**15)
    assert math.prod(primes) > 2 * 10**15 and len(set(primes)) == len(primes)
    assert all((p // 2) ** 2 * 64 <= 1 << 24 for p in primes)


def expected(rows):
    used = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        c = [math.floor(256 * x) for x in v]
        used[i] = min(used.get(i, (label, c)), (label, c))
    out = set()
    for a in used:
        if a % 50:
            continue
        score = {r: sum(x * y for x, y in zip(used[a][1], used[r][1])) for r in used if r != a}
        order = sorted(score, key=lambda r: (-score[r], r))
        for p in [r for r in order if used[r][0] == used[a][0]][:5]:
            fits = [r for r in order if used[r][0] != used[a][0] and 50 * score[p] <= 100 * score[r] <= 95 * score[p]]
            out |= {(a, p, k + 1, r, score[p], score[r]) for k, r in enumerate(fits[:3])}
    return out


def mined(spark, rows, **options):
    df = spark.createDataFrame([(i, label, v, 1.0) for i, label, v in rows], "vec_id long, label int, embedding array<double>, c double")
    found = H.hard_negatives(H.integer_vectors(H.relabelled(df)), F.col("vec_id") % 50 == 0, **options)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_equals_plain_arithmetic(spark):
    pick = random.Random(3)
    # coarse values, so that many scores are equal; half of the rows have one label
    rows = [(i, 1 if i % 2 else pick.randrange(10), [pick.randrange(-2, 4) / 4 for _ in range(6)]) for i in range(1, 403)]
    rows += rows[:30] + [(0, 3, [0.5] * 6), (450, 4, [-0.5] * 6), (-50, 4, [0.25] * 6)]
    bad = [(500, None, [1.0]), (550, 1, None), (600, 1, [1.0, None]), (650, 2, [float("nan")]), (None, 2, [1.0]), (700, 2, [float("inf")])]
    odd = [(750, 1, [0.5, 0.5]), (751, 2, []), (750, 0, [0.5, 0.25])]
    want = expected(rows + bad + odd)
    assert len(want) > 50 and mined(spark, rows + bad + odd) == want
    # a grid of many cells gives the same
    assert mined(spark, rows + bad + odd, block_rows=40) == want


def test_empty_and_too_large(spark):
    assert mined(spark, []) == set() and mined(spark, [(0, 1, [1.0])]) == set()
    with pytest.raises(ValueError, match="too large"):
        mined(spark, [(0, 1, [1e9]), (1, 1, [1e9])])
