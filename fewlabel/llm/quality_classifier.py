"""Ordinal cumulative-link regression on graded ratings over hashed text.

One score per text, the sum of the hashed weights of its distinct words, is
shared by all grades; ordered thresholds cut it: P(grade <= k) is the logistic
function of threshold k less the score. It is fitted by proximal Adagrad with
an absolute penalty on a bounded sample of rated documents (``PER_GRADE`` of
each grade, weighted back to the grades' shares over all ratings), over the
features whose presence depends on the grade (chi-square of ``LEAST_CHI2`` or
more): a long text would else add up the noise of thousands of neutral words.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from operator import eq
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick
from .texts import WordCache, add_columns

# Parameters: hashed features, rated documents used per grade, steps, rate and penalty of the fit.
BITS = 18
PER_GRADE = 1500
STEPS = 300
RATE = 0.5
PENALTY = 5e-4
LEAST_CHI2 = 30.0
GRADES = 3


def grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 toxic, 1 poor, 2 good; the worst of a document's ratings. Rows without an id or a rating go."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    rated = pick(labels, "doc_id", "quality", "toxic").select("doc_id", grade.alias("grade")).dropna()
    return rated.groupBy("doc_id").agg(F.min("grade").alias("grade"))


def word_features(word: bytes, bits: int = BITS) -> list[int]:
    """Hashed features of a word: itself lower-cased, beginnings, endings and all-capitals."""
    lower, mask = word.lower(), (1 << bits) - 1
    keys = [b"w" + lower, b"4" + lower[:4], b"5" + lower[:5], b"s" + lower[-3:], b"t" + lower[-2:]]
    if len(word) > 2 and word != lower and word == word.upper():
        keys.append(b"capitals")
    return [crc32(k) & mask for k in keys]


def text_features(words: list[bytes], bits: int = BITS) -> int:
    """Hashed feature of how often a word repeats its neighbour, in twentieths."""
    share = sum(map(eq, words, words[1:])) / max(len(words), 1)
    return crc32(b"repeats%d" % min(10, int(20 * share))) & ((1 << bits) - 1)


@dataclass
class Ordinal:
    """Weights by hashed feature, ordered thresholds; ``bits`` is the size of the hash."""

    weights: np.ndarray
    thresholds: np.ndarray
    bits: int

    def below(self, score) -> np.ndarray:
        """P(grade <= k) for each score and k."""
        return 1 / (1 + np.exp(np.clip(np.asarray(score)[..., None] - self.thresholds, -500, 500)))


def fit(features: list[np.ndarray], grade: np.ndarray, weight: np.ndarray, bits: int = BITS, steps: int = STEPS) -> Ordinal:
    """Maximum likelihood with an absolute penalty, from each text's distinct features, its grade and its weight."""
    flat = np.concatenate([np.asarray(f, np.int64) for f in features] or [np.empty(0, np.int64)])
    lengths = np.array([len(f) for f in features], np.int64)
    owner = np.repeat(np.arange(len(features)), lengths)
    used, index = np.unique(flat, return_inverse=True)
    telling = _chi2(index, grade[owner], len(used), np.bincount(grade, minlength=GRADES)) >= LEAST_CHI2
    index, owner, used = (np.cumsum(telling) - 1)[index[telling[index]]], owner[telling[index]], used[telling]
    w, squares = np.zeros(len(used)), np.full(len(used), 1e-8)
    share = np.array([weight[grade <= k].sum() for k in range(GRADES - 1)]) / max(weight.sum(), 1e-12)
    theta = np.log(np.clip(share, 0.01, 0.99) / (1 - np.clip(share, 0.01, 0.99)))
    theta[1:] = np.maximum(theta[1:], theta[:-1] + 0.1)
    theta_squares = np.full(GRADES - 1, 1e-8)
    weight = weight / max(weight.sum(), 1e-12)
    rows = np.arange(len(grade))
    for _ in range(steps if len(grade) else 0):
        score = np.bincount(owner, w[index], len(grade))
        f = np.zeros((len(grade), GRADES + 1))
        f[:, 1:-1] = 1 / (1 + np.exp(np.clip(score[:, None] - theta, -500, 500)))
        f[:, -1] = 1
        upper, lower = f[rows, grade + 1], f[rows, grade]
        p = np.maximum(upper - lower, 1e-12)
        slope = weight * (1 - upper - lower)  # of the loss by the score
        g = np.bincount(index, slope[owner], len(used))
        squares += g * g
        step = RATE / np.sqrt(squares)
        w -= step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * PENALTY, 0)
        density = f * (1 - f)
        g_theta = np.zeros(GRADES + 1)
        np.add.at(g_theta, grade + 1, -weight * density[rows, grade + 1] / p)
        np.add.at(g_theta, grade, weight * density[rows, grade] / p)
        theta_squares += g_theta[1:-1] ** 2
        theta = theta - RATE * g_theta[1:-1] / np.sqrt(theta_squares)
        theta[1:] = np.maximum(theta[1:], theta[:-1] + 0.1)
    weights = np.zeros(1 << bits, np.float32)
    weights[used] = w
    return Ordinal(weights, theta, bits)


def _chi2(index: np.ndarray, grade: np.ndarray, size: int, totals: np.ndarray) -> np.ndarray:
    """Chi-square of presence against grade for each feature, from one (feature, grade) per occurrence."""
    seen = np.bincount(index * GRADES + grade, minlength=size * GRADES).reshape(size, GRADES).astype(float)
    texts = max(totals.sum(), 1)
    present = seen.sum(axis=1, keepdims=True)
    out = np.zeros(size)
    for count, row in ((seen, present), (totals - seen, texts - present)):
        expected = row * totals / texts
        out += np.divide((count - expected) ** 2, expected, out=np.zeros_like(expected), where=expected > 0).sum(axis=1)
    return out


def train(docs: DataFrame, labels: DataFrame, per_grade: int = PER_GRADE, bits: int = BITS) -> Ordinal:
    """Fit on at most ``per_grade`` rated documents of each grade, in hash order of doc_id, with their whole texts."""
    rated = grades(labels)
    totals = {r["grade"]: r["count"] for r in rated.groupBy("grade").count().collect()}
    order = F.md5(F.concat(F.lit("rated:"), F.col("doc_id").cast("string")))
    parts = [rated.where(F.col("grade") == g).orderBy(order, "doc_id").limit(per_grade) for g in range(GRADES)]
    sample = parts[0].unionByName(parts[1]).unionByName(parts[2])
    # at most GRADES * per_grade rows of two integers
    chosen = pick(docs, "doc_id", "text").join(F.broadcast(sample), "doc_id")

    def make() -> Callable:
        def compute(texts: list) -> list[list]:
            out = []
            for text in texts:
                words = (text or b"").split()
                found = {x for w in set(words) for x in word_features(w, bits)}
                out.append(sorted(found | {text_features(words, bits)}) if words else [])
            return [out]

        return compute

    got = add_columns(chosen, make, {"features": "array<int>"}).select("doc_id", "grade", "features").toArrow()
    order_ = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    grade = got.column("grade").to_numpy()[order_].astype(np.int64)
    column = got.column("features").combine_chunks()
    features = [column[int(i)].values.to_numpy() for i in order_]
    seen = np.bincount(grade, minlength=GRADES)
    weight = np.array([totals.get(g, 0) / max(seen[g], 1) for g in range(GRADES)])[grade] if len(grade) else np.empty(0)
    return fit(features, grade, weight, bits)


def rate(docs: DataFrame, model: Ordinal, least: float = 0.5) -> DataFrame:
    """``docs`` with score, expected_grade, tail_probability (of the best grade) and kept (it is ``least`` or more).

    Texts without words, null ones too, have no evidence: score 0, expected
    grade 0, tail probability 0, not kept. Null ids and repeated rows are rated
    like others. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.weights, model.thresholds, model.bits))

    def make() -> Callable:
        weights, thresholds, bits = shared.value
        own = Ordinal(weights, thresholds, bits)
        # the features of a word that carry weight; a feature counts once in a text
        cache = WordCache(lambda w: tuple(x for x in word_features(w, bits) if weights[x]))

        def score(words: list[bytes]) -> float:
            found = set().union(*map(cache.__getitem__, set(words)))
            found.add(text_features(words, bits))
            return float(weights[sorted(found)].sum(dtype=np.float64))

        def compute(texts: list) -> list[list]:
            split = [(t or b"").split() for t in texts]
            scores = np.array([score(w) if w else 0.0 for w in split])
            some = np.array([bool(w) for w in split])
            below = own.below(scores)
            expected, tail = np.where(some, (1 - below).sum(axis=1), 0.0), np.where(some, 1 - below[:, -1], 0.0)
            return [scores.tolist(), expected.tolist(), tail.tolist(), (tail >= least).tolist()]

        return compute

    return add_columns(docs, make, {"score": "double", "expected_grade": "double", "tail_probability": "double", "kept": "boolean"})


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score, expected_grade, tail_probability, kept) for every row of ``docs(doc_id, text)``."""
    return rate(pick(docs, "doc_id", "text"), train(docs, labels)).drop("text")
