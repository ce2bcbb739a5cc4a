"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are token sequences (lower-cased letters and
digits of each word). Their shared seeds, hashes of ``TILE`` tokens in a row,
are joined; a pair that shares enough of an item's seeds is tiled: running
Karp-Rabin finds the longest matches, which are marked without overlap, longest
first, with ever shorter search lengths down to ``TILE``. The share of the
item's tokens under tiles is its coverage, whatever the order of the passages.

A bitmap of fixed size over the benchmark's seeds is what map tasks see of the
benchmark; only documents that hit it are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import arrow_map, pick, utf8
from .texts import WordCache

TILE = 5
COVERAGE = 0.8
FIRST_LENGTH = 20
BITMAP_BITS = 24
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)


def token(word: bytes) -> int:
    """Hash of a word's letters and digits in lower case; 0 if it has none."""
    kept = "".join(c for c in word.decode().lower() if c.isalnum())
    return xxhash.xxh64_intdigest(kept) or 1 if kept else 0


def tokens(text: bytes | None, of: Callable[[bytes], int] = token) -> np.ndarray:
    found = np.fromiter(map(of, (text or b"").split()), np.uint64)
    return found[found != 0]


def rolling(seq: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows, from running sums with powers of the base modulo 2**64."""
    n = len(seq) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(np.full(len(seq), BASE, np.uint64))
        back = np.multiply.accumulate(np.full(n, INVERSE, np.uint64))
        sums = np.concatenate(([np.uint64(0)], np.add.accumulate(seq * powers)))
        return (sums[length:] - sums[:n]) * back


def tiles(text: np.ndarray, item: np.ndarray, least: int = TILE, first: int = FIRST_LENGTH) -> list[tuple[int, int, int]]:
    """Greedy tiling: (start in text, start in item, length) of non-overlapping matches of ``least`` tokens or more."""
    a, b = text.tolist(), item.tolist()
    free_a, free_b = np.ones(len(a), bool), np.ones(len(b), bool)
    out: list[tuple[int, int, int]] = []

    def scan(length: int) -> list[tuple[int, int, int]]:
        """Maximal unmarked matches of ``length`` or more; only the first of over twice the length if there is one."""
        windows: dict[int, list[int]] = {}
        for j, h in enumerate(rolling(item, length).tolist()):
            windows.setdefault(h, []).append(j)
        hashes = rolling(text, length)
        found, done = [], set()
        for i in np.flatnonzero(np.isin(hashes, np.fromiter(windows, np.uint64, len(windows)))).tolist():
            for j in windows[int(hashes[i])]:
                if (i - 1, j - 1) in done and free_a[i - 1] and free_b[j - 1]:
                    done.add((i, j))  # inside the match that began earlier
                    continue
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and free_a[i + k] and free_b[j + k]:
                    k += 1
                if k >= length:
                    if k > 2 * length:
                        return [(i, j, k)]
                    found.append((i, j, k))
                    done.add((i, j))
        return found

    length = max(first, least)
    while True:
        found = scan(length)
        if len(found) == 1 and found[0][2] > 2 * length:
            length = found[0][2]
            continue
        again = False
        for i, j, k in sorted(found, key=lambda m: (-m[2], m[0], m[1])):
            if free_a[i : i + k].all() and free_b[j : j + k].all():
                free_a[i : i + k] = False
                free_b[j : j + k] = False
                out.append((i, j, k))
            else:
                again = True  # what is left of it may still be long enough
        if again:
            continue
        if length <= least:
            return sorted(out)
        length = max(length // 2, least)


def _bitmap_place(seeds: np.ndarray, bits: int) -> np.ndarray:
    return (seeds >> np.uint64(64 - bits)).astype(np.int64)


def _seed_rows(items: DataFrame) -> DataFrame:
    """(seed, item_id, item_tokens), a row for each seed of an item and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds, ids, lengths = [], [], []
            for item, text in zip(batch.column("item_id").to_pylist(), utf8(batch, "text")):
                found = tokens(text)
                own = rolling(found, TILE).view(np.int64).tolist()
                seeds += own
                ids += [item] * len(own)
                lengths += [len(found)] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(seeds, pa.int64()), pa.array(ids, pa.int64()), pa.array(lengths, pa.int64())], ["seed", "item_id", "item_tokens"])

    return arrow_map(items, run, "seed long, item_id long, item_tokens long")


def _bitmap(seeds: DataFrame, bits: int) -> bytes:
    """Bitmap of the seeds: each task sets bits of its own, their union has 2**bits bits whatever the benchmark's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.unique(_bitmap_place(batch.column("seed").to_numpy().view(np.uint64), bits))
            yield pa.RecordBatch.from_arrays([pa.array(place)], ["place"])

    places = arrow_map(seeds.select("seed"), run, "place long").distinct().toArrow().column("place").to_numpy()
    on = np.zeros(1 << bits, bool)
    on[places] = True
    return np.packbits(on, bitorder="little").tobytes()


def _hits(docs: DataFrame, bitmap: bytes, bits: int) -> DataFrame:
    """(doc_id, text, seeds) of the documents with a seed in the bitmap; seeds are those in it, once each."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on, cache = np.frombuffer(shared.value, np.uint8), WordCache(token)
        for batch in batches:
            keep, seeds = [], []
            for i, text in enumerate(utf8(batch, "text")):
                own = rolling(tokens(text, cache.__getitem__), TILE)
                place = _bitmap_place(own, bits)
                own = own[(on[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1]
                if len(own):
                    keep.append(i)
                    seeds.append(np.unique(own).view(np.int64))
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column("doc_id").cast(pa.int64()), kept.column("text"), pa.array(seeds, pa.list_(pa.int64()))], ["doc_id", "text", "seeds"])

    return arrow_map(docs, run, "doc_id long, text string, seeds array<long>")


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles, longest for each document row and item it covers to ``coverage`` or more.

    Null texts match nothing; items of fewer than ``TILE`` tokens and null items
    are never found. Rows with a null doc_id and repeated rows are reported like
    others; equally long tiles are marked from the start. Empty tables give an
    empty result. Further columns are ignored.
    """
    items = materialise(pick(benchmark, "item_id", "text").select(F.col("item_id").cast("long").alias("item_id"), "text"), "benchmark")
    seeds = materialise(_seed_rows(items), "benchmark-seeds")
    hits = _hits(pick(docs, "doc_id", "text"), _bitmap(seeds, BITMAP_BITS), BITMAP_BITS)
    hits = materialise(hits.withColumn("row", F.monotonically_increasing_id()), "seed-hits")
    places = seeds.groupBy("seed", "item_id", "item_tokens").agg(F.count("*").alias("places"))
    # tiles of TILE tokens or more that cover the share hold at least this many of the item's seeds
    least = F.ceil(coverage * F.col("item_tokens") / TILE - 1e-9)
    pairs = (
        hits.select("row", F.explode("seeds").alias("seed")).join(places, "seed")
        .groupBy("row", "item_id", "item_tokens").agg(F.sum("places").alias("shared")).where(F.col("shared") >= least)
    )
    # one passage may be in a third of all documents: pairs meet the texts by row, items by a small table
    pairs = pairs.join(hits.select("row", "doc_id", "text"), "row").join(items.withColumnRenamed("text", "item"), "item_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCache(token)
        for batch in batches:
            shares, counts, longest = [], [], []
            for text, item in zip(utf8(batch, "text"), utf8(batch, "item")):
                own = tokens(item, cache.__getitem__)
                found = tiles(tokens(text, cache.__getitem__), own)
                shares.append(sum(k for _, _, k in found) / max(len(own), 1))
                counts.append(len(found))
                longest.append(max((k for _, _, k in found), default=0))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("item_id"), pa.array(shares, pa.float64()), pa.array(counts, pa.int64()), pa.array(longest, pa.int64())],
                ["doc_id", "item_id", "coverage", "n_tiles", "longest"],
            )

    tiled = arrow_map(pairs.select("doc_id", "item_id", "text", "item"), run, "doc_id long, item_id long, coverage double, n_tiles long, longest long")
    return tiled.where(F.col("coverage") >= coverage)


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without the documents that cover an item; rows without a doc_id stay."""
    found = materialise(contaminated(docs, benchmark, coverage).select("doc_id").distinct(), "contaminated")
    return docs.join(found, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
