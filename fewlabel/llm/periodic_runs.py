"""Periodic runs of words: stretches that repeat a period, found by descending LCP.

Per text, suffixes of the word sequence are sorted by doubling and the common
prefix (LCP) of neighbours is taken. Neighbours are united from the longest
LCP down (Kruskal); each class keeps its positions in order. Positions that
become next to each other in a class at distance d, where the LCP is at least
d, start a square and so seed the run of period d around them. Were there a
smaller period, a position in between would have been united before; hence a
seed's distance is the smallest period, and every run has a seed.

A run of length L >= e * q and L >= m seeds at an LCP of at least
L - q >= m (e - 1) / e, so classes below that are never united; a text in which
no stretch of so many words occurs twice (nearly all) ends at a comparison of
hashes, which can only send too many texts on.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words_of
from .texts import add_columns

MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # fixed values: odd constants for mixing


def may_repeat(words: list[bytes], reach: int) -> bool:
    """Whether ``reach`` words in a row may occur twice; never false when they do."""
    n = len(words) - reach + 1
    if n < 2:
        return False
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(MULTIPLIERS[0])
    held, factor = 1, MULTIPLIERS[1]
    while held * 2 <= reach:
        h = h[: len(h) - held] * np.uint64(factor) + h[held:]
        held, factor = held * 2, factor * factor % (1 << 64)
    h = np.sort(h[:n])
    return bool((h[1:] == h[:-1]).any())


def suffix_order(ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, and per level k the class of each position by its first 2^k words.

    Classes are named by the place of their first member, so splitting one
    leaves the others as they are; only classes of several suffixes are sorted.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    sorted_ids = ids[order]
    fresh = np.r_[True, sorted_ids[1:] != sorted_ids[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    levels, k = [rank], 1
    while k < n:
        size = np.bincount(rank, minlength=n)
        active = np.flatnonzero(size[rank] > 1)
        if not len(active):
            break
        beyond = active + k
        second = np.where(beyond < n, rank[np.minimum(beyond, n - 1)] + 1, 0)
        key = rank[active] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        active, key, old = active[by], key[by], rank[active[by]]
        at = np.arange(len(active))
        sub = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], at, 0))
        top = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], at, 0))
        rank = rank.copy()
        rank[active] = old + sub - top
        levels.append(rank)
        k *= 2
    return np.argsort(rank, kind="stable"), levels


def common_prefixes(a: np.ndarray, b: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Length of the common prefix of the suffixes at ``a`` and ``b`` (which differ), pair by pair."""
    n, length = len(levels[0]), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = a + length, b + length
        inside = (i < n) & (j < n)
        same = inside & (levels[k][np.minimum(i, n - 1)] == levels[k][np.minimum(j, n - 1)])
        length += np.where(same, 1 << k, 0)
    return length


class Runs:
    """Maximal runs met so far, by period."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.by_period = ids, {}

    def seed(self, i: int, d: int) -> None:
        """The run of period ``d`` around the square at ``i``, unless it is known.

        Runs of one period overlap by less than it, so only the last one that
        starts at or before ``i`` can hold the square.
        """
        starts, ends = self.by_period.setdefault(d, ([], []))
        at = bisect_right(starts, i)
        if at and ends[at - 1] >= i + 2 * d:
            return
        start, end = i - self._same(i - 1, d, -1), i + d + self._same(i, d, 1)
        at = bisect_left(starts, start)
        starts.insert(at, start)
        ends.insert(at, end)

    def _same(self, i: int, d: int, step: int) -> int:
        """How many words from ``i`` on, in direction ``step``, equal those d further on; in windows that double."""
        count, width, last = 0, 32, len(self.ids) - d
        while True:
            low, high = (i, min(i + width, last)) if step > 0 else (max(i - width + 1, 0), i + 1)
            if low >= high:
                return count
            differs = self.ids[low:high] != self.ids[low + d : high + d]
            if step < 0:
                differs = differs[::-1]
            if differs.any():
                return count + int(differs.argmax())
            count += high - low
            i, width = i + step * (high - low), width * 2

    def all(self, min_length: int, exponent: int) -> list[tuple[int, int, int]]:
        found = ((s, e - s, d) for d, (starts, ends) in self.by_period.items() for s, e in zip(starts, ends))
        return sorted((s, n, d) for s, n, d in found if n >= max(min_length, exponent * d))


def find_runs(words: list[bytes], min_length: int = 24, exponent: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of each maximal run of length >= max(min_length, exponent * period), by start, then period."""
    reach = -(-min_length * (exponent - 1) // exponent)
    if len(words) < min_length or not may_repeat(words, reach):
        return []
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    order, levels = suffix_order(ids)
    lcp = common_prefixes(order[:-1], order[1:], levels)
    runs, place = Runs(ids), order.tolist()
    parent, held = list(range(len(words))), {}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    near = np.flatnonzero(lcp >= reach)
    for t in near[np.argsort(-lcp[near], kind="stable")].tolist():
        a, b = find(t), find(t + 1)
        large, small = held.pop(a, None) or [place[a]], held.pop(b, None) or [place[b]]
        if len(large) < len(small):
            a, b, large, small = b, a, small, large
        parent[b] = a
        if 8 * len(small) > len(large):
            large = sorted(large + small)
        else:
            for x in small:
                large.insert(bisect_left(large, x), x)
        held[a] = large
        widest = int(lcp[t]) // (exponent - 1)
        for x in small:
            p = bisect_left(large, x)
            if p and x - large[p - 1] <= widest:
                runs.seed(large[p - 1], x - large[p - 1])
            if p + 1 < len(large) and large[p + 1] - x <= widest:
                runs.seed(x, large[p + 1] - x)
    return runs.all(min_length, exponent)


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words outside every run's part after its first period, joined by one space."""
    if runs:
        gone = np.zeros(len(words), bool)
        for start, length, period in runs:
            gone[start + period : start + length] = True
        words = [w for w, g in zip(words, gone.tolist()) if not g]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, min_length: int = 24, exponent: int = 3) -> DataFrame:
    """``docs`` with the runs of ``text`` (run_start, run_length, run_period: arrays of equal length, by start,
    then period) and ``collapsed``, the words without repetitions.

    A null, empty or blank text has no runs and an empty ``collapsed``. Rows are
    independent: repeated rows, null ids and further columns stay; columns of the
    new names are replaced. An empty table gives an empty table. A text is worked
    on whole, in O(n log^2 n) for n words.
    """

    def make():
        def run(texts: list) -> list[list]:
            split = [(t or b"").split() for t in texts]
            found = [find_runs(words, min_length, exponent) for words in split]
            columns = [[[r[k] for r in runs] for runs in found] for k in range(3)]
            return [*columns, [collapsed(words, runs).decode() for words, runs in zip(split, found)]]

        return run

    return add_columns(docs, make, {"run_start": "array<long>", "run_length": "array<long>", "run_period": "array<long>", "collapsed": "string"})


def planted(docs: DataFrame) -> DataFrame:
    """``docs`` of which a tenth (by crc32 of the id) repeat, from a place on, the words that follow it.

    With h the checksum, g = h div 10, n words, a = g mod n and p = 1 + (n - a) div (3 + g mod 8), word i >= a
    becomes word a + (i - a) mod p. Other texts, and those without an id or a word, stay.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.withColumn("__h", h).withColumn("__w", F.when(F.col("__h") % 10 == 0, words_of(F.col("text"))))
    g, n = F.floor(F.col("__h") / 10), F.size("__w")
    # F.when keeps texts without words away from the remainder by zero
    sized = chosen.withColumns({"__a": F.when(n > 0, g % n).cast("int")}).withColumn("__p", (1 + F.floor((n - F.col("__a")) / (3 + g % 8))).cast("int"))
    a, p = F.col("__a"), F.col("__p")
    cycle = F.flatten(F.array_repeat(F.slice("__w", a + 1, p), F.ceil((n - a) / p).cast("int")))
    changed = F.concat(F.slice("__w", F.lit(1), a), F.slice(cycle, F.lit(1), n - a))
    return sized.withColumn("text", F.when(a.isNotNull(), F.array_join(changed, " ")).otherwise(F.col("text"))).drop("__h", "__w", "__a", "__p")


def strongest(runs: Column) -> Column:
    """Of an array of (start, length, period), the run of greatest exact length / period; ties: least start, then period.

    Whole numbers are compared crosswise, so that no rounding decides.
    """

    def better(best: Column, r: Column) -> Column:
        gain = r["length"] * best["period"] - best["length"] * r["period"]
        return F.when(best.isNull() | (gain > 0), r).otherwise(best)

    # runs come by start, then period, so the first of equals stays
    return F.reduce(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better)



def digests(rows: DataFrame) -> DataFrame:
    """Per document the number of runs, the strongest one and checksums of all runs and of the collapsed words."""
    zipped = F.transform(
        F.arrays_zip("run_start", "run_length", "run_period"),
        lambda r: F.struct(r["run_start"].alias("start"), r["run_length"].alias("length"), r["run_period"].alias("period")),
    )
    listed = rows.withColumn("runs", zipped).withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listing = F.concat_ws("", F.transform(lines, lambda x: F.concat(x, F.lit("\n"))))
    best = F.col("best")
    return listed.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listing, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
