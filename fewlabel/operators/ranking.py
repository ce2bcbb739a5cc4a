"""Exact ranks in hash order without sorting a whole table in one task."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from itertools import product
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialise

HEX_DIGITS = 3  # 4096 buckets; md5 spreads the rows evenly over them


def hash_bucket(hash_: Column, digits: int = HEX_DIGITS) -> Column:
    """Leading hex digits: a bucket that keeps the hash order."""
    return F.substring(hash_, 1, digits)


def _offsets(rows: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Rows before each bucket, per group; pre-aggregated on the map side."""
    counts = rows.groupBy(*groups, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*groups).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0)))


def bucketed_rank(
    df: DataFrame,
    groups: Sequence[str],
    bucket: Column,
    order: Sequence[str],
    out: str = "rank",
    k: Column | int | None = None,
) -> DataFrame:
    """1-based exact rank by ``order`` within each group.

    ``bucket`` must not decrease along ``order``. Counts per bucket (4096 small
    rows per group) give offsets; only then are rows ranked, inside their
    bucket. With ``k`` the buckets that start after rank k are dropped by a
    broadcast join before any row is shuffled, so drawing a small budget moves
    little more than the budget itself.
    """
    rows = df.withColumn("__bucket", bucket)
    offsets = _offsets(rows, groups)
    if k is not None:
        offsets = offsets.where(F.col("__off") < k)
    keyed = rows.join(F.broadcast(offsets.drop("__n")), [*groups, "__bucket"])
    inside = W.partitionBy(*groups, "__bucket").orderBy(*order)
    ranked = keyed.withColumn(out, (F.row_number().over(inside) + F.col("__off")).cast("long"))
    if k is not None:
        ranked = ranked.where(F.col(out) <= k)
    return ranked.drop("__bucket", "__off")


def hash_rank(
    df: DataFrame,
    hash_: Column,
    id_: str,
    groups: Sequence[str] = (),
    out: str = "rank",
    k: Column | int | None = None,
) -> DataFrame:
    """Exact rank (optionally the first k) in hash order, ties by id."""
    rows = df.withColumn("__hash", hash_)
    ranked = bucketed_rank(rows, groups, hash_bucket(F.col("__hash")), ["__hash", id_], out, k)
    return ranked.drop("__hash")


SLACK = 6.0  # standard deviations of a binomial draw that a cutoff leaves in hand


def cutoff(k: int, n: int, slack: float = SLACK) -> str | None:
    """Hex prefix that about ``k`` and a few of ``n`` evenly spread hashes lie below; None if all may be needed."""
    share = (k + slack * k**0.5 + slack * slack) / max(n, 1)
    return None if share >= 1 else f"{int(share * (1 << 64)):016x}"


def hash_draws(
    df: DataFrame, id_: str, dims: Mapping[str, Sequence[int]], size: Callable[[dict[str, int]], int], seed: int, salt: str, out: str = "rank"
) -> DataFrame:
    """For every combination of ``dims``, the first ``size`` rows of its own hash order, with their rank.

    A row's hashes (those of ``hash_key``; a row without id has none) are computed
    once per combination, beside each other in the row, and only those below the combination's cutoff (its share of the rows
    and some slack) copy the row. What is left is stored; a combination that
    came out short, which the slack makes rare, is drawn again with a wider
    cutoff, in the end with none, so that the result is exact.
    """
    n = df.count()
    draws = [dict(zip(dims, map(int, values))) for values in product(*dims.values())]

    def survivors(wanted: list[dict[str, int]], slack: float) -> DataFrame:
        own = F.col(id_).cast("string")
        marks = []
        for d in wanted:
            # the same key as hash_key's, its constant parts joined beforehand
            key = F.md5(F.concat(F.lit(":".join(map(str, [seed, *d.values(), salt, ""]))), own))
            mark = F.struct(*[F.lit(v).cast("long").alias(c) for c, v in d.items()], key.alias("__hash"))
            cut = cutoff(size(d), n, slack)
            marks.append(mark if cut is None else F.when(key < F.lit(cut), mark))
        below = F.array_compact(F.array(*marks))
        # a plain explode would have the hashes computed once more, by the filter the planner derives from it
        rows = df.withColumn("__d", F.explode_outer(below)).where("__d.__hash is not null")
        return materialise(rows.select(*df.columns, *[F.col(f"__d.{c}").alias(c) for c in dims], F.col("__d.__hash").alias("__hash")), "draws")

    kept, slack = survivors(draws, SLACK), SLACK
    while True:
        found = {tuple(r[c] for c in dims): r["count"] for r in kept.groupBy(*dims).count().collect()}
        short = [d for d in draws if found.get(tuple(d.values()), 0) < min(size(d), n)]
        if not short:
            break
        slack *= 100
        again = survivors(short, slack)
        repaired = F.lit(False)
        for d in short:
            repaired = repaired | reduce(and_, [F.col(c) == v for c, v in d.items()])
        kept = kept.where(~repaired).unionByName(again)
    k = reduce(lambda rest, d: F.when(reduce(and_, [F.col(c) == v for c, v in d.items()]), F.lit(size(d))).otherwise(rest), draws, F.lit(0))
    ranked = bucketed_rank(kept, list(dims), hash_bucket(F.col("__hash")), ["__hash", id_], out, k)
    return ranked.drop("__hash")


def hash_bands(
    df: DataFrame,
    hash_: Column,
    id_: str,
    cuts: Sequence[Column | int],
    labels: Sequence[str],
    groups: Sequence[str] = (),
    out: str = "split",
) -> DataFrame:
    """Label rows by bands of the hash order: ranks up to cuts[0] get labels[0], ...

    A bucket that lies inside one band is labelled from its offset alone; rows
    are ranked only in the few buckets a cut falls into.
    """
    if len(labels) != len(cuts) + 1:
        raise ValueError("need one label more than cuts")
    cut_cols = [c if isinstance(c, Column) else F.lit(c) for c in cuts]

    def band(rank: Column) -> Column:
        label = F.lit(labels[-1])
        for cut, name in reversed(list(zip(cut_cols, labels))):
            label = F.when(rank <= cut, F.lit(name)).otherwise(label)
        return label

    rows = df.withColumn("__hash", hash_).withColumn("__bucket", hash_bucket(F.col("__hash")))
    offsets = (
        _offsets(rows, groups)
        .withColumn("__first", band(F.col("__off") + 1))
        .withColumn("__last", band(F.col("__off") + F.col("__n")))
    )
    keyed = rows.join(F.broadcast(offsets.drop("__n")), [*groups, "__bucket"])
    pure = keyed.where(F.col("__first") == F.col("__last")).withColumn(out, F.col("__first"))
    inside = W.partitionBy(*groups, "__bucket").orderBy("__hash", id_)
    mixed = keyed.where(F.col("__first") != F.col("__last")).withColumn(
        out, band(F.row_number().over(inside) + F.col("__off"))
    )
    drop = ["__hash", "__bucket", "__off", "__first", "__last"]
    return pure.drop(*drop).unionByName(mixed.drop(*drop))
