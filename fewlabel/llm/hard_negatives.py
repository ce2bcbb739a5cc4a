"""Hard negatives by exact integer inner products in a residue number system.

Integer components are replaced by their remainders modulo several small
primes, centred around zero and so small that a float32 matrix product of them
is exact. Each product of residues is one float32 GEMM; the signed score is
put together from the remainders by balanced mixed radix digits (Chinese
remainders). The number of primes follows from a bound on any score, which one
pass over the vectors gives (Cauchy-Schwarz); it isn't a parameter.

Anchors meet rows in a grid: both are dealt to blocks of bounded size by the
hash of their id, and each cell of the grid (one block of anchors, one block
of rows) is a group of its own. A cell returns a few rows per anchor, which a
window over (anchor) or (anchor, positive) then ranks. Labels and copies of
vectors don't matter to how rows are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import pick

BLOCK_ROWS = 16_384
CHUNK = 1024  # components that one product adds up before it is reduced
EXACT = 1 << 24  # whole numbers up to here are exact in float32
TILE = 2_000_000  # scores that a task holds at once
LEAST = np.iinfo(np.int64).min
MOST_CELLS = 50_000


# --- residues -------------------------------------------------------------------


def primes_for(dim: int, bound: int) -> list[int]:
    """Largest primes whose centred products over ``dim`` components stay exact, enough to tell -bound from bound."""
    half = int((EXACT / max(min(dim, CHUNK), 1)) ** 0.5)
    chosen, product, p = [], 1, min(2 * half + 1, 2047)
    while product <= 2 * bound + 1 or len(chosen) < 2:
        while p > 2 and any(p % q == 0 for q in range(2, int(p**0.5) + 1)):
            p -= 1
        if p <= 2:
            raise ValueError("no primes are left below the size that float32 products allow")
        chosen.append(p)
        product *= p
        p -= 1
    return chosen


def centred(x: np.ndarray, p: int) -> np.ndarray:
    """Remainders of whole float32 numbers below 2^24, in -(p-1)/2 .. (p-1)/2."""
    x = x - np.float32(p) * np.rint(x * np.float32(1 / p))
    half = np.float32(p // 2)
    x -= np.float32(p) * (x > half)
    x += np.float32(p) * (x < -half)
    return x


def residues(values: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """One float32 matrix of centred remainders of int64 components for each prime."""
    out = []
    for p in primes:
        r = values % p
        out.append((r - p * (r > p // 2)).astype(np.float32))
    return out


def scores(a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact inner products (rows of a x rows of b) as int64, from their residue matrices."""
    digits: list[np.ndarray] = []
    for k, p in enumerate(primes):
        total = None
        for start in range(0, a[k].shape[1], CHUNK):
            part = centred(a[k][:, start : start + CHUNK] @ b[k][:, start : start + CHUNK].T, p)
            total = part if total is None else centred(total + part, p)
        if total is None:
            return np.zeros((len(a[k]), len(b[k])), np.int64)
        if digits:
            # what the digits found so far stand for, modulo p, by Horner's rule
            known = centred(digits[-1], p)
            for q, d in zip(reversed(primes[: k - 1]), reversed(digits[:-1])):
                known = centred(known * np.float32(q % p) + centred(d, p), p)
            inverse = pow(int(np.prod([q % p for q in primes[:k]], dtype=object)) % p, -1, p)
            total = centred(centred(total - known, p) * np.float32(inverse - p * (inverse > p // 2)), p)
        digits.append(total)
    out = digits[-1].astype(np.int64)
    for q, d in zip(reversed(primes[:-1]), reversed(digits[:-1])):
        out *= q
        out += d.astype(np.int64)
    return out


def best(s: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The k greatest of each row of ``s``, which is used up: (rows, columns, values), the least column first among equals."""
    line = np.arange(len(s))
    for _ in range(min(k, s.shape[1])):
        at = s.argmax(axis=1)
        value = s[line, at]
        fine = value > LEAST
        if not fine.any():
            return
        yield line[fine], at[fine], value[fine]
        s[line, at] = LEAST


# --- blocks -----------------------------------------------------------------------


def vectors_of(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """A list column as a matrix; shorter vectors are filled with zeros."""
    column = column.combine_chunks()
    size = np.asarray(column.value_lengths())
    values = np.asarray(column.flatten())
    if (size == dim).all():
        return values.reshape(-1, dim)
    out = np.zeros((len(size), dim), np.int64)
    out[np.arange(dim) < size[:, None]] = values
    return out


class Block:
    """Rows of one block by id: ids, labels and residues."""

    def __init__(self, rows: pa.Table, dim: int, primes: list[int]):
        rows = rows.sort_by("vec_id")
        self.rows, self.ids = rows, rows.column("vec_id").to_numpy()
        self.labels = rows.column("label").to_numpy()
        self.residues = residues(vectors_of(rows.column("c"), dim), primes)

    def part(self, places: np.ndarray | slice) -> list[np.ndarray]:
        return [r[places] for r in self.residues]


def tiles(n: int, width: int) -> Iterator[np.ndarray]:
    step = max(1, TILE // max(width, 1))
    for start in range(0, n, step):
        yield np.arange(start, min(start + step, n))


def gathered(parts: list[list[np.ndarray]], names: list[str]) -> pa.Table:
    columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * len(names)
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)})


# --- the operator --------------------------------------------------------------------


def integer_vectors(rows: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, c): each component x as floor(scale * x).

    Rows with a null id, label, vector or component or a component that isn't
    finite take no part. Of rows with the same id the least by label, then
    components, is used.
    """
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    used = pick(rows, "vec_id", "label", "embedding").where("vec_id is not null and label is not null and embedding is not null").where(fine)
    whole = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    pairs = used.select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(F.col("label").cast("long").alias("label"), whole.alias("c")).alias("v"))
    one = pairs.groupBy("vec_id").agg(F.min("v").alias("v"))
    return one.select("vec_id", "v.label", "v.c")


def hard_negatives(
    vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors`` are (vec_id, label, c) with unique ids and whole components,
    ``anchor`` says which rows ask. An anchor's positives are its first
    ``positives`` other rows of the same label; for each, the first ``negatives``
    rows of another label with low * positive_score <= 100 * negative_score <=
    high * positive_score are returned. Higher scores come first, ties by the
    smaller id. Vectors of different lengths are filled up with zeros. An anchor
    without positives, or a positive without negatives, gives no row, as does an
    empty table. Scores whose hundredfold doesn't fit in 64 bits stop the job.
    """
    spark = vectors.sparkSession
    table = materialise(pick(vectors, "vec_id", "label", "c"), "vectors")
    norm = F.aggregate("c", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    seen = table.agg(F.count("*").alias("n"), F.count(F.when(anchor, 1)).alias("asking"), F.max(norm).alias("norm"), F.max(F.size("c")).alias("dim")).first()
    dim, bound = int(seen["dim"] or 0), int((seen["norm"] or 0.0) * (1 + 1e-9)) + 1
    if 100 * bound >= 1 << 63:
        raise ValueError("components too large: a score may exceed 64 bits")
    primes = primes_for(dim, bound)
    row_blocks, anchor_blocks = (max(1, -(-int(k) // block_rows)) for k in (seen["n"], seen["asking"]))
    cells = min(row_blocks * anchor_blocks, MOST_CELLS)

    def dealt(side: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        """Each row in its own block, once for every block of the other side."""
        number = F.pmod(F.xxhash64("vec_id", F.lit(own)), F.lit(blocks)).cast("int")
        return side.withColumn(own, number).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).repartition(cells, "i", "j")

    def grid(asking: DataFrame, work, schema: str) -> DataFrame:
        rows = dealt(table, "i", row_blocks, "j", anchor_blocks)
        return rows.groupBy("i", "j").cogroup(dealt(asking, "j", anchor_blocks, "i", row_blocks).groupBy("i", "j")).applyInArrow(work, schema)

    def nearest(rows: pa.Table, asking: pa.Table) -> pa.Table:
        parts = []
        if rows.num_rows and asking.num_rows:
            r, q = Block(rows, dim, primes), Block(asking, dim, primes)
            for label in np.intersect1d(r.labels, q.labels):
                here, there = np.flatnonzero(q.labels == label), np.flatnonzero(r.labels == label)
                side, ids = r.part(there), r.ids[there]
                for tile in tiles(len(here), len(there)):
                    s = scores(q.part(here[tile]), side, primes)
                    s[q.ids[here[tile]][:, None] == ids] = LEAST
                    parts += [[q.ids[here[tile]][line], ids[at], value] for line, at, value in best(s, positives)]
        return gathered(parts, ["anchor_id", "positive_id", "score"])

    def between(rows: pa.Table, asking: pa.Table) -> pa.Table:
        parts = []
        if rows.num_rows and asking.num_rows:
            r, q = Block(rows, dim, primes), Block(asking, dim, primes)
            given = q.rows.column("positives").to_pylist()
            ids = np.full((len(given), positives), -1, np.int64)
            mark = np.zeros((len(given), positives), np.int64)
            there = np.zeros((len(given), positives), bool)
            for n, found in enumerate(given):
                for k, p in enumerate(found):
                    ids[n, k], mark[n, k], there[n, k] = p["positive_id"], p["score"], True
            floor, top = -((-low * mark) // 100), (high * mark) // 100
            there &= floor <= top
            for tile in tiles(len(given), len(r.ids)):
                s = scores(q.part(tile), r.residues, primes)
                s[q.labels[tile][:, None] == r.labels] = LEAST
                for k in range(positives):
                    asked = tile[there[tile, k]]
                    if not len(asked):
                        continue
                    own = s[there[tile, k]]
                    own[(own > top[asked, k][:, None]) | (own < floor[asked, k][:, None])] = LEAST
                    parts += [
                        [q.ids[asked][line], ids[asked[line], k], mark[asked[line], k], r.ids[at], value] for line, at, value in best(own, negatives)
                    ]
        return gathered(parts, ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    asking = table.where(anchor).toDF("vec_id", "label", "c")  # own columns beside those of the rows
    close = grid(asking, nearest, "anchor_id long, positive_id long, score long")
    first = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id")
    chosen = close.withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives)
    # at most ``positives`` entries per anchor
    listed = chosen.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "score")).alias("positives"))
    ready = asking.join(listed, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id")
    found = grid(ready, between, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def relabelled(rows: DataFrame) -> DataFrame:
    """``rows`` with the label of every seventh id moved on by one, modulo ten."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.withColumn("label", moved)


SQL = """
WITH used AS (
  SELECT vec_id::BIGINT AS id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.id AS anchor_id, r.id AS id, a.label = r.label AS same, list_inner_product(a.c, r.c)::BIGINT AS score
  FROM used a, used r WHERE a.id % 50 = 0 AND a.id <> r.id
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score,
    (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id))::INTEGER AS rank
  FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id
  WHERE NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
) WHERE rank <= 3
"""
