"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints within distance 2h share a value within distance h of
both. Every fingerprint therefore emits all values of its ball of radius h
(2081 for h = 2), equal values meet, and the fingerprints that emitted one
value are linked to the least of them: each is within h of that value, so all
are within 2h of one another. Links are deduplicated and their distance is
verified; components of the links are the groups.

Not the 2081 values are shuffled but few copies of the fingerprint: the 64 bits
are dealt into k parity checks, a flipped bit flips one check, so all values of
a ball lie in 1 + k + k(k-1)/2 buckets (for h = 2) named by their checks, and a
copy sent to each bucket emits there the values that belong to it. k follows
the number of distinct fingerprints, so that a bucket stays small.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import arrow_map, components, keep_by_id, first_rows, pick, utf8

SHINGLE = 4
SEED = 42
RADIUS = 4
# Values that one bucket should emit, and the most that are sorted at once.
BUCKET_VALUES = 2_000_000
SORTED_VALUES = 8_000_000


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Bitwise majority of the shingles' XXH64; texts without words have zero."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest, counts, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(words) - shingle + 1
    for at in range(0, total, 65536):
        a, b = starts[at : min(at + 65536, total)], ends[at + shingle - 1 : at + shingle - 1 + 65536]
        hashes = np.array([digest(joined[i:j], SEED) for i, j in zip(a.tolist(), b.tolist())], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for every row of ``docs(doc_id, text)``; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t) for t in utf8(batch, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(values)], ["doc_id", "fp"])

    return arrow_map(pick(docs, "doc_id", "text"), run, "doc_id long, fp long")


def _flips(checks: int, half: int) -> dict[int, np.ndarray]:
    """All flips of at most ``half`` bits, by the parity checks they change; bit b belongs to check b mod k."""
    by: dict[int, list[int]] = {}
    for n in range(half + 1):
        for bits in combinations(range(64), n):
            value = change = 0
            for b in bits:
                value |= 1 << b
                change ^= 1 << (b % checks)
            by.setdefault(change, []).append(value)
    return {k: np.array(v, np.uint64) for k, v in by.items()}


def _meet(flips: dict[int, np.ndarray], change: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, least fingerprint) of those that emit an equal value in one bucket."""
    blocks = [(np.unique(fp[change == c]), flips[int(c)]) for c in np.unique(change)]
    passes = max(1, math.ceil(sum(len(f) * len(e) for f, e in blocks) / SORTED_VALUES))
    odd, found = np.uint64(0x9E3779B97F4A7C15), []
    for turn in range(passes):

        def emitted() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for f, e in blocks:
                step = max(1, SORTED_VALUES // (8 * len(e)))
                for at in range(0, len(f), step):
                    own = f[at : at + step]
                    values, owner = (own[:, None] ^ e[None, :]).ravel(), np.repeat(own, len(e))
                    if passes > 1:
                        mine = (values * odd >> np.uint64(40)) % np.uint64(passes) == turn
                        values, owner = values[mine], owner[mine]
                    yield values, owner

        values = np.concatenate([v for v, _ in emitted()])
        values.sort()
        shared = np.unique(values[1:][values[1:] == values[:-1]])
        del values
        if not len(shared):
            continue
        filter_ = np.zeros(1 << 20, bool)
        filter_[(shared * odd) >> np.uint64(44)] = True
        vs, fs = [], []
        for v, f in emitted():
            maybe = filter_[(v * odd) >> np.uint64(44)]
            v, f = v[maybe], f[maybe]
            at = np.searchsorted(shared, v)
            at[at == len(shared)] = 0
            same = shared[at] == v
            vs.append(v[same])
            fs.append(f[same])
        v, f = np.concatenate(vs), np.concatenate(fs)
        order = np.lexsort((f, v))
        v, f = v[order], f[order]
        first = np.concatenate(([True], v[1:] != v[:-1]))
        least = f[first][np.cumsum(first) - 1]
        found.append(np.unique(np.stack([f, least])[:, f != least], axis=1))
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    a, b = np.unique(np.concatenate(found, axis=1), axis=1)
    return a, b


def links(fps: DataFrame, radius: int = RADIUS, checks: int | None = None) -> DataFrame:
    """Links (a, b) that connect all distinct values ``fps(fp)`` within ``radius`` bits (an even number).

    Fingerprints that share a value are linked to the least of them, so the
    links span the same components as all pairs within the radius do.
    """
    if radius % 2 or radius < 0:
        raise ValueError("the radius must be even: both sides take half of it")
    half = radius // 2
    if checks is None:
        ball = sum(math.comb(64, n) for n in range(half + 1))
        checks = min(32, max(8, math.ceil(math.log2(max(fps.count() * ball / BUCKET_VALUES, 1)))))
    flips = _flips(checks, half)

    def signed(x: int) -> int:
        return x - (1 << 64) if x >> 63 else x

    bucket = F.lit(0).cast("long")
    for c in range(checks):
        mask = signed(sum(1 << b for b in range(c, 64, checks)))
        bucket = bucket.bitwiseOR(F.shiftleft(F.bit_count(F.col("fp").bitwiseAND(F.lit(mask))).cast("long").bitwiseAND(F.lit(1)), c))
    copies = fps.select("fp", bucket.alias("own"), F.explode(F.array(*[F.lit(c).cast("long") for c in sorted(flips)])).alias("change"))
    copies = copies.select(F.col("own").bitwiseXOR(F.col("change")).alias("bucket"), "change", "fp")

    def meet(table: pa.Table) -> pa.Table:
        change, fp = table.column("change").to_numpy(), table.column("fp").to_numpy().view(np.uint64)
        a, b = _meet(flips, change, fp)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    met = copies.groupBy("bucket").applyInArrow(meet, "a long, b long")
    return met.distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id of the group) for every row.

    Null and blank texts have fingerprint zero and are linked like any other.
    A null doc_id stays null and never names a group; a group of such rows only
    has a null component_id. Repeated rows are returned as often as they come.
    An empty table gives an empty result. Further columns are ignored.
    """
    owned = materialise(fingerprints(docs), "simhash")
    distinct = materialise(owned.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    roots = components(links(distinct.select("fp"), radius), "simhash-links")
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = named.select("fp", "root").join(least, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return owned.join(labels, "fp").select("doc_id", hexed, "component_id")


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One document of each near-duplicate group: the least doc_id; repeated rows of it leave one.

    Rows without a doc_id can't be told apart from others and stay.
    """
    groups = near_duplicates(docs, radius)
    kept = groups.where("doc_id = component_id").select("doc_id").distinct()
    return first_rows(keep_by_id(docs, kept))
