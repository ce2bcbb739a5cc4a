"""Ridge paths on wide sparse designs by conjugate gradients; no matrix is ever formed.

A design row is z = g * (1?, x): a sparse text vector x, with a column of ones
in front where the surrogate needs one, times a gain g. With row weights w and
a free intercept, the normal operator on centred columns is
v -> sum w (z'v - mean_w(z'v)) z. All penalties of a path are solved side by
side, so each step reads the rows once. Over a table the operator's matrix of
the widest columns, as many as the driver may hold, is added up first; its
inverse preconditions these columns, the diagonal all others.

:class:`Design` does this for rows that a task holds; :func:`sparse_ridge_path`
for a table of any number of rows, and :func:`sparse_ridge_fits` for many nested
training sets of such a table together: tasks add up their part of the
operator's value, the parts are summed natively and only columns x penalties
numbers reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

TOLERANCE = 1e-11  # of the residual against the right-hand side
DRIVER_NUMBERS = 4_000_000  # columns x penalties that the driver and each task may hold
BLOCK_NUMBERS = 1 << 18  # of a design, in one stored block
ROWS_OF_MATRIX = 1024  # of a design, spread out at once
DENSE = 16  # cells of a block for each number in it, up to which the block is held as a matrix
RANKED = {"idx": np.int32, "val": np.float64, "counts": np.int32, "rank": np.int64, "y": np.float64, "a": np.float64}
PACKED = {"idx": np.int32, "val": np.float64, "counts": np.int32, "t": np.float64, "w": np.float64, "g": np.float64}


class Sparse:
    """Rows of a sparse matrix that a task holds."""

    def __init__(self, idx: np.ndarray, val: np.ndarray, counts: np.ndarray, columns: int):
        self.idx, self.val, self.counts, self.columns = idx, val, counts, columns

    @cached_property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    @classmethod
    def of(cls, idx: pa.ChunkedArray, val: pa.ChunkedArray, columns: int) -> Sparse:
        """From list columns; a null list is an empty row."""
        idx, val = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (idx, val))
        counts = np.asarray(idx.value_lengths().fill_null(0)).astype(np.int64)
        return cls(np.asarray(idx.flatten()).astype(np.int64), np.asarray(val.flatten()).astype(float), counts, columns)

    def taken(self, rows: np.ndarray) -> Sparse:
        """The chosen rows (a mask), in order."""
        held = rows[self.row]
        return Sparse(self.idx[held], self.val[held], self.counts[rows], self.columns)

    def ordered(self, rows: np.ndarray) -> Sparse:
        """The chosen rows (places), in the order given."""
        starts, counts = np.cumsum(self.counts) - self.counts, self.counts[rows]
        at = np.repeat(starts[rows] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        return Sparse(self.idx[at], self.val[at], counts, self.columns)

    def head(self, n: int) -> Sparse:
        """The first ``n`` rows."""
        held = int(self.counts[:n].sum())
        return Sparse(self.idx[:held], self.val[:held], self.counts[:n], self.columns)

    def with_ones(self) -> Sparse:
        """A column of ones put in front."""
        starts = np.cumsum(self.counts) - self.counts
        return Sparse(np.insert(self.idx + 1, starts, 0), np.insert(self.val, starts, 1.0), self.counts + 1, self.columns + 1)

    def dot(self, d: np.ndarray) -> np.ndarray:
        """Rows times each column of ``d``."""
        out, held = np.zeros((len(self.counts), d.shape[1])), np.flatnonzero(self.counts)
        starts = (np.cumsum(self.counts) - self.counts)[held]
        for k in range(d.shape[1] if len(held) else 0):
            parts = np.ascontiguousarray(d[:, k]).take(self.idx)
            parts *= self.val
            out[held, k] = np.add.reduceat(parts, starts)
        return out

    def tdot(self, u: np.ndarray) -> np.ndarray:
        """Transposed rows times each column of ``u``."""
        out = np.empty((self.columns, u.shape[1]))
        for k in range(u.shape[1]):
            parts = np.repeat(u[:, k], self.counts)
            parts *= self.val
            out[:, k] = np.bincount(self.idx, parts, self.columns)
        return out

    def squares(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.idx, self.val * self.val * w[self.row], self.columns)


class Design:
    """Weighted, gained rows; gives the sums and the operator that a ridge path needs."""

    def __init__(self, x: Sparse, t: np.ndarray, w: np.ndarray, g: np.ndarray):
        self.x, self.t, self.w, self.g = x, t, w, g

    def sums(self) -> np.ndarray:
        """In one vector: sum w, sum w t, then sums of w z, w z t and w z^2 for each column."""
        wg = (self.w * self.g)[:, None]
        first = self.x.tdot(np.hstack([wg, wg * self.t[:, None]]))
        return np.concatenate([[self.w.sum(), self.w @ self.t], first[:, 0], first[:, 1], self.x.squares(self.w * self.g**2)])

    def turn(self, v: np.ndarray, mean: np.ndarray) -> np.ndarray:
        """The operator's part of these rows for each column of ``v``, ``mean`` being mean_w(z)'v."""
        u = self.g[:, None] * self.x.dot(v) - mean
        return self.x.tdot((self.w * self.g)[:, None] * u)

    def matrix(self, places: np.ndarray, wide: int) -> np.ndarray:
        """The sum of w z z' over the ``wide`` columns that have a place (0 on; others -1)."""
        out, at = np.zeros((wide, wide)), places.take(self.x.idx)
        held = np.flatnonzero(at >= 0)
        row, at, parts = self.x.row[held], at[held], self.x.val[held]
        parts *= (np.sqrt(self.w) * self.g)[row]
        for start in range(0, len(self.t), ROWS_OF_MATRIX):
            stop = min(start + ROWS_OF_MATRIX, len(self.t))
            own = slice(*np.searchsorted(row, [start, stop]))
            z = np.bincount((row[own] - start) * wide + at[own], parts[own], (stop - start) * wide).reshape(-1, wide)
            out += z.T @ z
        return out


class Wide:
    """The operator's matrix of some columns, taken apart once for all penalties."""

    def __init__(self, columns: np.ndarray, matrix: np.ndarray):
        self.columns = columns
        self.values, self.vectors = np.linalg.eigh(matrix)

    def eased(self, r: np.ndarray, alpha: np.ndarray) -> np.ndarray:
        return self.vectors @ (self.vectors.T @ r / np.maximum(np.maximum(self.values, 0.0)[:, None] + alpha, 1e-12))


def solved(
    sums: np.ndarray,
    turn: Callable[[np.ndarray, np.ndarray], np.ndarray],
    alphas: Sequence[float],
    steps: int,
    tolerance: float = TOLERANCE,
    wide: Wide | None = None,
) -> np.ndarray:
    """Coefficients for each penalty (intercept first), one column each; see :func:`solved_together`."""
    return solved_together(sums[None], lambda v, mean, on: turn(v, mean), alphas, steps, tolerance, wide)


def solved_together(
    sums: np.ndarray,
    turn: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray],
    alphas: Sequence[float],
    steps: int,
    tolerance: float = TOLERANCE,
    wide: Wide | None = None,
) -> np.ndarray:
    """Coefficients of several paths (a row of ``sums`` each), intercept first: one column per path and, inside it, penalty.

    Conjugate gradients preconditioned by the diagonal, and by the matrix of the
    ``wide`` columns where it is given; a column that has converged no longer takes part (``turn`` is told the places of those that
    do). A path that needs more than ``steps`` stops the job.
    """
    p = (sums.shape[1] - 2) // 3
    weight, total = sums[:, 0], sums[:, 1]
    z, zt, zz = sums[:, 2:].reshape(-1, 3, p).transpose(1, 2, 0)
    if (weight <= 0).any():
        raise ValueError("a ridge path needs rows of positive weight")
    path, alpha = np.repeat(np.arange(len(sums)), len(alphas)), np.tile(np.asarray(alphas, float), len(sums))
    mean = z / weight
    rhs = (zt - mean * total)[:, path]
    scale = np.maximum((zz - weight * mean**2)[:, path] + alpha, 1e-12)
    b, r = np.zeros_like(rhs), rhs.copy()
    size = np.linalg.norm(rhs, axis=0)

    def eased(on: np.ndarray) -> np.ndarray:
        s = r[:, on] / scale[:, on]
        if wide is not None:
            s[wide.columns] = wide.eased(r[np.ix_(wide.columns, on)], alpha[on])
        return s

    d = eased(np.arange(len(path)))
    energy = (r * d).sum(axis=0)
    on = np.flatnonzero(size > 0)
    for _ in range(steps):
        if not len(on):
            break
        v = d[:, on]
        q = turn(v, (mean[:, path[on]] * v).sum(axis=0), on) + alpha[on] * v
        step = energy[on] / np.maximum((v * q).sum(axis=0), 1e-300)
        b[:, on] += step * v
        r[:, on] -= step * q
        s = eased(on)
        new = (r[:, on] * s).sum(axis=0)
        d[:, on] = s + new / np.maximum(energy[on], 1e-300) * v
        energy[on] = new
        on = on[np.linalg.norm(r[:, on], axis=0) > tolerance * size[on]]
    else:
        if len(on):
            raise RuntimeError(f"a ridge path has not converged in {steps} steps")
    return np.vstack([(total / weight)[path] - (mean[:, path] * b).sum(axis=0), b])


def fit_rows(x: Sparse, y: np.ndarray, alphas: Sequence[float], w: np.ndarray | None = None, steps: int = 2000) -> np.ndarray:
    """Ridge path over rows that a task holds: intercept and coefficients, one column per penalty."""
    ones = np.ones(len(y))
    design = Design(x, y, ones if w is None else w, ones)
    return solved(design.sums(), design.turn, alphas, steps)


def fit_exact_rows(x: Sparse, y: np.ndarray, a: np.ndarray, alphas: Sequence[float], steps: int = 2000) -> np.ndarray:
    """Minimisers of the sample IF variance: design a (1, x), outcome a y, free centring (which is dropped)."""
    design = Design(x.with_ones(), a * y, np.ones(len(y)), a)
    return solved(design.sums(), design.turn, alphas, steps)[1:]


def _cuts(counts: np.ndarray) -> Iterator[tuple[slice, slice]]:
    """Rows of blocks of about ``BLOCK_NUMBERS`` numbers, and their numbers."""
    ends = np.concatenate([[0], np.cumsum(counts)])
    start = 0
    while start < len(counts):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + BLOCK_NUMBERS, "right")) - 1)
        yield slice(start, stop), slice(ends[start], ends[stop])
        start = stop


def pack(batches: Iterable[pa.RecordBatch], columns: int, ones: bool) -> Iterator[pa.RecordBatch]:
    """Rows (idx, val, t, w, g) as blocks of about ``BLOCK_NUMBERS`` numbers: one stored row each, its fields the arrays' bytes."""
    for batch in batches:
        x = Sparse.of(batch.column("idx"), batch.column("val"), columns)
        x = x.with_ones() if ones else x
        for rows, held in _cuts(x.counts):
            fields = {"idx": x.idx[held], "val": x.val[held], "counts": x.counts[rows]}
            fields |= {c: np.asarray(batch.column(c))[rows] for c in ("t", "w", "g")}
            yield pa.RecordBatch.from_pydict({c: pa.array([fields[c].astype(kind).tobytes()], pa.binary()) for c, kind in PACKED.items()})


def unpacked(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[Design]:
    """The designs of stored blocks, one after the other."""
    for batch in batches:
        for i in range(batch.num_rows):
            idx, val, counts, t, w, g = (np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in PACKED.items())
            yield Design(Sparse(idx.astype(np.int64), val, counts, width), t, w, g)


def sparse_ridge_path(
    rows: DataFrame,
    y: str,
    columns: int,
    alphas: Sequence[float],
    weight: Column | None = None,
    gain: Column | None = None,
    steps: int = 2000,
    tolerance: float = 1e-8,
) -> np.ndarray:
    """Ridge path over a table with sparse columns ``idx``, ``val``: intercept first, one column per penalty.

    With ``gain`` (the IF weights a) it is the exact IF-variance surrogate:
    design a (1, x), outcome a y; the centring is dropped from the result, so
    its first row is the coefficient of the ones. The rows are stored once, packed
    to blocks, which each step reads as they are; a step moves columns x
    penalties numbers per task, and has two tasks per core at most. One pass more
    adds up the matrix of the columns with the largest sums of squares, whose
    numbers the driver may hold (2000 columns): they need most of the steps.
    """
    exact, width = gain is not None, columns + (gain is not None)
    if width * max(len(alphas), 3) > DRIVER_NUMBERS:
        raise ValueError(f"{width} columns x {len(alphas)} penalties exceed the {DRIVER_NUMBERS} numbers the driver may hold")
    one = F.lit(1.0)
    g = gain.cast("double") if exact else one
    used = rows.select("idx", "val", (F.col(y).cast("double") * g).alias("t"), (weight if weight is not None else one).cast("double").alias("w"), g.alias("g"))
    packed = used.mapInArrow(lambda batches: pack(batches, columns, exact), ", ".join(f"{c} binary" for c in PACKED))
    context = rows.sparkSession.sparkContext
    table = materialise(packed, "design").coalesce(2 * context.defaultParallelism)

    def summed(work: Callable[[Design], np.ndarray], upper: bool = False) -> list[np.ndarray]:
        """The rows of the sum over all rows of what ``work`` gives, or only what they hold from the diagonal on."""

        def run(batches: Iterable[pa.RecordBatch]):
            parts = None
            for design in unpacked(batches, width):
                part = work(design)
                parts = part if parts is None else np.add(parts, part, out=parts)
            if parts is not None:
                for start in range(0, len(parts), 64):
                    own = range(start, min(start + 64, len(parts)))
                    rows = [parts[i, i * upper :] for i in own]
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(rows, pa.list_(pa.float64()))], ["k", "v"])

        parts = table.mapInArrow(run, "k int, v array<double>").select("k", array_to_vector("v").alias("v"))
        total = parts.groupBy("k").agg(vector_to_array(Summarizer.sum(F.col("v"))).alias("v")).toArrow()
        rows = total.column("v").combine_chunks()
        return [rows[i].values.to_numpy() for i in np.argsort(total.column("k").to_numpy()).tolist()]

    def turn(v: np.ndarray, mean: np.ndarray) -> np.ndarray:
        shared = context.broadcast((v, mean))
        try:
            return np.array(summed(lambda design: design.turn(*shared.value).T)).T
        finally:
            shared.unpersist()

    def widest(sums: np.ndarray) -> Wide:
        z, _, zz = sums[2:].reshape(3, width)
        mean, size = z / sums[0], min(width, isqrt(DRIVER_NUMBERS))
        columns = np.argsort(sums[0] * mean**2 - zz, kind="stable")[:size]
        places = np.full(width, -1)
        places[columns] = np.arange(size)
        shared = context.broadcast(places)
        try:
            rows = summed(lambda design: design.matrix(shared.value, size), True)
        finally:
            shared.unpersist()
        matrix = np.zeros((size, size))
        for i, row in enumerate(rows):
            matrix[i, i:] = matrix[i:, i] = row
        return Wide(columns, matrix - sums[0] * np.outer(mean[columns], mean[columns]))

    sums = summed(lambda design: design.sums()[None])
    if not len(sums):
        raise ValueError("a ridge path needs rows of positive weight")
    path = solved(sums[0], turn, alphas, steps, tolerance, widest(sums[0]) if sums[0][0] > 0 else None)
    return path[1:] if exact else path


@dataclass(frozen=True)
class Fit:
    """A path over the rows of ``group`` ranked up to ``last``: ``plain``; ``weighted`` by a^2, at most ``cap``, over ``mean``; or ``exact``."""

    group: int
    last: int
    kind: str = "plain"
    target: int = 0
    cap: float | None = None
    mean: float = 1.0


class Ranked:
    """Rows of one group by rank, their outcome and IF weights (one column per target)."""

    def __init__(self, x: Sparse, rank: np.ndarray, y: np.ndarray, a: np.ndarray):
        self.x, self.rank, self.y, self.a = x, rank, y, a
        self.matrix = None
        if len(y) * x.columns <= DENSE * len(x.idx):
            self.matrix = np.zeros((len(y), x.columns))
            np.add.at(self.matrix, (x.row, x.idx), x.val)

    def parts(self, fits: Sequence[Fit]) -> Iterator[tuple[np.ndarray, np.ndarray | Sparse, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For the fits of each training size that has rows here: their places, the rows, gains, row weights, outcomes (a column per fit), which are exact."""
        for last in sorted({f.last for f in fits}):
            n = int(np.searchsorted(self.rank, last, "right"))
            if not n:
                continue
            places = np.array([i for i, f in enumerate(fits) if f.last == last])
            g, w = np.ones((n, len(places))), np.ones((n, len(places)))
            for k, i in enumerate(places):
                a = self.a[:n, fits[i].target] if self.a.shape[1] else None
                if fits[i].kind == "exact":
                    g[:, k] = a
                elif fits[i].kind == "weighted" and fits[i].mean > 0:
                    w[:, k] = (a * a if fits[i].cap is None else np.minimum(a * a, fits[i].cap)) / fits[i].mean
            yield places, self.x.head(n) if self.matrix is None else self.matrix[:n], g, w, g * self.y[:n, None], np.array([fits[i].kind == "exact" for i in places])

    def sums(self, fits: Sequence[Fit]) -> np.ndarray:
        """One row per fit, as :meth:`Design.sums` gives them, the column of ones (of exact fits, zero for others) in front."""
        out = np.zeros((len(fits), 2 + 3 * (self.x.columns + 1)))
        for places, x, g, w, t, exact in self.parts(fits):
            wg, n = w * g, len(places)
            squared = Sparse(x.idx, x.val**2, x.counts, x.columns) if isinstance(x, Sparse) else x * x
            first = _tdot(x, np.hstack([wg, wg * t]))
            for k, u in enumerate((first[:, :n], first[:, n:], _tdot(squared, wg * g))):
                ones = ((wg, wg * t, wg * g)[k].sum(axis=0) * exact)[None]
                out[places, 2 + k * (self.x.columns + 1) : 2 + (k + 1) * (self.x.columns + 1)] = np.vstack([ones, u]).T
            out[places, 0], out[places, 1] = w.sum(axis=0), (w * t).sum(axis=0)
        return out

    def products(self, fits: Sequence[Fit]) -> np.ndarray:
        """One row per fit: :meth:`sums`, then the upper triangle of the sums of w z z'."""
        upper = np.triu_indices(self.x.columns + 1)
        out = np.zeros((len(fits), len(upper[0])))
        whole = np.zeros((len(self.y), self.x.columns + 1))
        whole[:, 0] = 1.0
        np.add.at(whole, (self.x.row, self.x.idx + 1), self.x.val)
        for places, _, g, w, _, exact in self.parts(fits):
            z = whole[: len(g)]
            for k, i in enumerate(places):
                m = (z * (w[:, k] * g[:, k] ** 2)[:, None]).T @ z
                m[0] *= exact[k]
                out[i] = m[upper]
        return np.hstack([self.sums(fits), out])

    def turn(self, fits: Sequence[Fit], v: np.ndarray, mean: np.ndarray) -> np.ndarray:
        """The operator's part of these rows for each column of ``v``, one row per column; ``fits`` names the fit of each."""
        out = np.zeros(v.T.shape)
        for places, x, g, w, _, exact in self.parts(fits):
            u = w * g * (g * (x.dot(v[1:, places]) + v[0, places]) - mean[places])
            out[places] = np.vstack([(u.sum(axis=0) * exact)[None], _tdot(x, u)]).T
        return out


def _tdot(x: np.ndarray | Sparse, u: np.ndarray) -> np.ndarray:
    return x.tdot(u) if isinstance(x, Sparse) else x.T @ u


def _turned(matrices: np.ndarray, which: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Each column of ``v`` times the matrix it names."""
    out = np.empty_like(v)
    for i in np.unique(which).tolist():
        out[:, which == i] = matrices[i] @ v[:, which == i]
    return out


def pack_ranked(batches: Iterable[pa.RecordBatch], columns: int) -> Iterator[pa.RecordBatch]:
    """Rows (group, rank, y, a, idx, val) as stored blocks of one group each, by rank."""
    for batch in batches:
        whole = Sparse.of(batch.column("idx"), batch.column("val"), columns)
        group, rank, y = (np.asarray(batch.column(c)) for c in ("group", "rank", "y"))
        a = np.array(batch.column("a").to_pylist(), float).reshape(batch.num_rows, -1)
        for one in np.unique(group).tolist():
            order = np.flatnonzero(group == one)
            order = order[np.argsort(rank[order], kind="stable")]
            x = whole.ordered(order)
            for rows, held in _cuts(x.counts):
                fields = {"idx": x.idx[held], "val": x.val[held], "counts": x.counts[rows]}
                fields |= {"rank": rank[order][rows], "y": y[order][rows], "a": a[order][rows]}
                packed = {c: pa.array([fields[c].astype(kind).tobytes()], pa.binary()) for c, kind in RANKED.items()}
                yield pa.RecordBatch.from_pydict({"group": pa.array([one], pa.int64()), **packed})


def unpacked_ranked(batches: Iterable[pa.RecordBatch], columns: int) -> Iterator[tuple[int, Ranked]]:
    """(group, rows) of stored blocks, one after the other."""
    for batch in batches:
        for i in range(batch.num_rows):
            idx, val, counts, rank, y, a = (np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in RANKED.items())
            yield batch.column("group")[i].as_py(), Ranked(Sparse(idx.astype(np.int64), val, counts, columns), rank, y, a.reshape(len(y), -1))


def sparse_ridge_fits(
    rows: DataFrame, fits: Sequence[Fit], columns: int, alphas: Sequence[float], steps: int = 2000, tolerance: float = TOLERANCE
) -> Iterator[tuple[Fit, np.ndarray]]:
    """Ridge paths of many nested training sets over a table: intercept and coefficients, one column per penalty.

    ``rows`` are group, rank, y, ``a`` (one IF weight per target), idx and val.
    They are stored once as blocks, which a task reads one after the other:
    neither a task nor a group ever holds a training set, so its size doesn't
    matter. Where the matrix of a fit is within the numbers the driver may
    hold, one pass adds up those of as many fits as are; else every step reads
    the blocks, again for as many fits as the driver may hold numbers of.
    """
    width = columns + 1
    if width * max(len(alphas), 3) > DRIVER_NUMBERS:
        raise ValueError(f"{width} columns x {len(alphas)} penalties exceed the {DRIVER_NUMBERS} numbers the driver may hold")
    context = rows.sparkSession.sparkContext
    packed = rows.select("group", "rank", F.col("y").cast("double").alias("y"), "a", "idx", "val").mapInArrow(
        lambda batches: pack_ranked(batches, columns), "group long, " + ", ".join(f"{c} binary" for c in RANKED)
    )
    table = materialise(packed, "ranked").coalesce(2 * context.defaultParallelism)
    narrow = width * width <= DRIVER_NUMBERS
    most = DRIVER_NUMBERS // (width * max(width if narrow else 0, len(alphas), 3))

    def summed(wanted: Sequence[Fit], size: int, work: Callable[[Ranked, list[Fit], np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum over all blocks of what ``work`` gives for the fits of a block's group (and their places), a row of ``size`` numbers each."""

        def run(batches: Iterable[pa.RecordBatch]):
            parts, met = None, np.zeros(len(wanted), bool)
            for group, block in unpacked_ranked(batches, columns):
                places = np.array([i for i, f in enumerate(wanted) if f.group == group and f.last >= block.rank[0]], np.int64)
                if len(places):
                    parts = np.zeros((len(wanted), size)) if parts is None else parts
                    parts[places] += work(block, [wanted[i] for i in places], places)
                    met[places] = True
            if parts is not None:
                numbers = pa.array(parts[met].ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(met.sum() + 1) * size, pa.int32()), numbers)
                yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(met), pa.int32()), lists], ["k", "v"])

        parts = table.mapInArrow(run, "k int, v array<double>").select("k", array_to_vector("v").alias("v"))
        got = parts.groupBy("k").agg(vector_to_array(Summarizer.sum(F.col("v"))).alias("v")).toArrow()
        out = np.zeros((len(wanted), size))
        if got.num_rows:
            out[np.asarray(got.column("k"))] = np.asarray(got.column("v").combine_chunks().flatten()).reshape(-1, size)
        return out

    for start in range(0, len(fits), most):
        own = list(fits[start : start + most])
        each = [f for f in own for _ in alphas]  # the fit of each column

        def turn(v: np.ndarray, mean: np.ndarray, on: np.ndarray) -> np.ndarray:
            shared = context.broadcast((v, mean))
            try:
                return summed([each[i] for i in on], width, lambda block, some, at: block.turn(some, shared.value[0][:, at], shared.value[1][at])).T
            finally:
                shared.unpersist()

        head = 2 + 3 * width
        if narrow:
            upper = np.triu_indices(width)
            got = summed(own, head + len(upper[0]), lambda block, some, at: block.products(some))
            sums, matrices = got[:, :head], np.zeros((len(own), width, width))
            for m, s, part in zip(matrices, sums, got[:, head:]):
                m[upper] = part
                m += np.triu(m, 1).T - np.outer(s[2 : 2 + width], s[2 : 2 + width]) / max(s[0], 1e-300)
            paths = solved_together(sums, lambda v, mean, on: _turned(matrices, on // len(alphas), v), alphas, steps, tolerance)
        else:
            sums = summed(own, head, lambda block, some, at: block.sums(some))
            paths = solved_together(sums, turn, alphas, steps, tolerance)
        for i, f in enumerate(own):
            path = paths[:, i * len(alphas) : (i + 1) * len(alphas)]
            # of exact fits the centring is dropped, of others the column of ones, which they don't have
            yield f, path[1:] if f.kind == "exact" else np.delete(path, 1, axis=0)


def capped_square_weights(a: np.ndarray, clip: float | None) -> np.ndarray:
    """a squared, capped at a quantile and divided by its mean; all ones if degenerate."""
    w = a * a
    if clip is not None and 0 < clip < 1 and len(w) > 1:
        cap = np.quantile(w, clip)
        w = np.minimum(w, cap) if cap > 0 else w
    mean = w.mean()
    return w / mean if mean > 0 else np.ones_like(w)
