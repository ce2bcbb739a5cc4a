"""Exact percentiles of many columns together, by a few passes; no task ranks more than a fixed number of values."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ACCURACY = 10_000
BINS = 256  # of a histogram that narrows a range
MOST_RANKED = 20_000  # rows of a range that are ranked in one task
MARGIN = 3 / ACCURACY  # a sketch errs by at most 1 / ACCURACY of the rows


def exact_quantiles(df: DataFrame, value: Column, probs: Sequence[float]) -> list[float | None]:
    """Linear-interpolated percentiles of one column; see :func:`exact_quantiles_of`."""
    return exact_quantiles_of(df, {"x": value}, probs)["x"]


def _narrowed(wide: DataFrame, ranges: dict, below: dict, inside: dict, at: dict, most: int) -> dict[tuple, tuple[float, float]]:
    """Narrows each range (column, place) to at most ``most`` rows around its wanted place, or to one value.

    Each pass counts the rows of all ranges that are still too long in
    histograms of their own; a range then shrinks to the values seen in the bin
    of the wanted row. Where the row after it lies in another bin, both values
    are ends of their bins; they are returned and the range is done. A range of
    two values or more has both its ends in different bins, so it shrinks.
    """
    met: dict[tuple, tuple[float, float]] = {}

    def long(k: tuple) -> bool:
        low, high = ranges[k]
        return inside[k] > most and low < high and math.isfinite(low) and math.isfinite(high)

    while wanted := [k for k in ranges if long(k)]:
        marks = []
        for n, k in enumerate(wanted):
            x, (low, high) = F.col(f"__{k[0]}"), ranges[k]
            share = (x / 2 - F.lit(low / 2)) / F.lit(high / 2 - low / 2)
            place = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(share * BINS))).cast("int")
            marks.append(F.when(x.between(F.lit(low), F.lit(high)), F.struct(F.lit(n).alias("k"), place.alias("bin"), x.alias("x"))))
        seen = wide.select(F.explode_outer(F.array_compact(F.array(*marks))).alias("m")).where("m.k is not null")
        bins = seen.groupBy("m.k", "m.bin").agg(F.count("*").alias("n"), F.min("m.x").alias("low"), F.max("m.x").alias("high"))
        held: dict[int, list] = {}
        for r in sorted(bins.collect(), key=lambda r: (r["k"], r["bin"])):  # at most BINS rows for each range
            held.setdefault(r["k"], []).append(r)
        for n, k in enumerate(wanted):
            passed, chosen = 0, []
            for r in held[n]:
                if passed <= at[k] + 1 and passed + r["n"] > at[k]:
                    chosen.append((passed, r))
                passed += r["n"]
            start, own = chosen[0]
            if len(chosen) > 1:
                met[k] = own["high"], chosen[1][1]["low"]
                del ranges[k]
            else:
                ranges[k] = own["low"], own["high"]
                below[k], inside[k], at[k] = below[k] + start, own["n"], at[k] - start
    return met


def exact_quantiles_of(
    df: DataFrame, values: Mapping[str, Column], probs: Sequence[float], margin: float = MARGIN, most: int = MOST_RANKED
) -> dict[str, list[float | None]]:
    """Linear-interpolated percentiles of several columns; a column without values has none.

    Quantile sketches give a narrow range around each wanted place, the rows
    below and inside each range are counted, ranges of more than ``most`` rows
    are narrowed by histograms (256 times a pass, all columns together), and
    only the rows left (equal values merged) are ranked. A range that misses its
    place, which the sketch's bound rules out, is widened until it is the whole
    column.
    """
    wide = df.select(*[c.cast("double").alias(f"__{i}") for i, c in enumerate(values.values())])
    pending, found = [(i, j) for i in range(len(values)) for j in range(len(probs))], {}
    counts = wide.agg(*[F.count(f"__{i}") for i in range(len(values))]).first() if values else []
    pending = [(i, j) for i, j in pending if counts[i]]
    while pending:
        grid = [min(max(p + s * margin, 0.0), 1.0) for p in probs for s in (-1, 1)]
        edges = wide.agg(*[F.percentile_approx(f"__{i}", grid, ACCURACY) if margin < 1 else F.array(F.min(f"__{i}"), F.max(f"__{i}")) for i in range(len(values))]).first()
        ranges = {(i, j): (edges[i][2 * j], edges[i][2 * j + 1]) if margin < 1 else tuple(edges[i]) for i, j in pending}
        counted = wide.agg(
            *[F.count(F.when(F.col(f"__{i}") < F.lit(ranges[i, j][0]), 1)) for i, j in pending],
            *[F.count(F.when(F.col(f"__{i}").between(*map(F.lit, ranges[i, j])), 1)) for i, j in pending],
        ).first()
        below, inside = (dict(zip(pending, part)) for part in (counted[: len(pending)], counted[len(pending) :]))
        at = {(i, j): int((counts[i] - 1) * probs[j]) - below[i, j] for i, j in pending}
        last = {(i, j): int((counts[i] - 1) * probs[j]) + 1 >= counts[i] for i, j in pending}
        missed = [k for k in pending if at[k] < 0 or at[k] + 1 - last[k] >= inside[k]]
        if missed and margin >= 1:
            raise AssertionError("a percentile lies outside its column")
        fine = [k for k in pending if k not in missed]
        ranges = {k: ranges[k] for k in fine}
        pairs = _narrowed(wide, ranges, below, inside, at, most)
        pairs |= _ranked(wide, ranges, at) if ranges else {}
        for i, j in fine:
            (low, high), place = pairs[i, j], (counts[i] - 1) * probs[j]
            found[i, j] = low if last[i, j] or high == low else low + (high - low) * (place - int(place))
        pending, margin = missed, margin * 30
    return {name: [found.get((i, j)) for j in range(len(probs))] for i, name in enumerate(values)}


def _ranked(wide: DataFrame, ranges: dict, at: dict) -> dict[tuple, tuple[float, float]]:
    """The values at each wanted place and at the one after it, from the rows inside its range."""
    keys = list(ranges)
    marks = [
        F.when(F.col(f"__{k[0]}").between(*map(F.lit, ranges[k])), F.struct(F.lit(n).alias("k"), F.col(f"__{k[0]}").alias("x"))) for n, k in enumerate(keys)
    ]
    inside = wide.select(F.explode_outer(F.array_compact(F.array(*marks))).alias("m")).where("m.k is not null").groupBy("m.k", "m.x").agg(F.count("*").alias("n"))
    running = W.partitionBy("k").orderBy("x").rowsBetween(W.unboundedPreceding, W.currentRow)
    wanted = F.element_at(F.create_map(*[F.lit(v) for n, k in enumerate(keys) for v in (n, at[k])]), F.col("k"))
    ranked = inside.withColumn("until", F.sum("n").over(running)).withColumn("at", wanted)
    # the values of the wanted place and of the one after it
    picked = ranked.where("until > at and until - n <= at + 1").groupBy("k").agg(
        F.min(F.when(F.expr("until > at and until - n <= at"), F.col("x"))).alias("low"),
        F.min(F.when(F.expr("until > at + 1 and until - n <= at + 1"), F.col("x"))).alias("high"),
    )
    return {keys[r["k"]]: (r["low"], r["high"]) for r in picked.collect()}
