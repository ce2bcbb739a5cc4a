"""Arrow loops over whole texts that pass the other columns through, and a bounded cache per distinct word."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from .common import arrow_map

CACHED_WORDS = 200_000
CACHED_BYTES = 64


def with_fields(rows: DataFrame, new: dict[str, str]) -> ST.StructType:
    """The schema of ``rows`` and further columns; built from fields, since names needn't be plain words."""
    return ST.StructType([*rows.schema.fields, *[ST.StructField(c, ST.DataType.fromDDL(k)) for c, k in new.items()]])


class WordCache(dict):
    """``cache[word]`` computes a word's value once; emptied when full, so its memory is bounded."""

    def __init__(self, compute: Callable, limit: int = CACHED_WORDS):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, word):
        value = self.compute(word)
        if len(word) <= CACHED_BYTES:
            if len(self) >= self.limit:
                self.clear()
            self[word] = value
        return value


def add_columns(docs: DataFrame, make: Callable[[], Callable[[list], list[list]]], new: dict[str, str], binary: bool = True) -> DataFrame:
    """``docs`` with further columns computed from ``text``.

    ``make`` runs once per task and gives a function from a list of texts (as
    UTF-8 bytes if ``binary``, null as None) to one list per new column. A
    column of a new name replaces the one in ``docs``.
    """
    kept = [c for c in docs.columns if c not in new]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))
    types = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64()), "array<long>": pa.list_(pa.int64())}
    place = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            row = batch.column("row")
            text = row.field(place)
            made = compute((text.cast(pa.binary()) if binary else text).to_pylist())
            arrays = [pa.array(values, types[kind]) for values, kind in zip(made, new.values())]
            yield pa.RecordBatch.from_arrays([row, *arrays], ["row", *new])

    mapped = arrow_map(rows, run, with_fields(rows, new))
    return mapped.select(*[F.col(f"row.`{c}`") for c in kept], *new)


class RowCache:
    """A row of numbers per distinct word, ``compute``d for all new ones together; ``ids`` maps words to rows of ``rows`` until the next ``start``.

    ``start`` forgets everything once ``limit`` words are held, so memory is
    bounded by the limit and the words of one turn.
    """

    def __init__(self, compute: Callable, width: int, limit: int = CACHED_WORDS):
        self.compute, self.limit = compute, limit
        self.rows = np.zeros((1024, width), np.float32)
        self.used, self.known = 0, {}

    def start(self) -> None:
        if self.used >= self.limit:
            self.used, self.known = 0, {}
            self.rows = np.zeros((1024, self.rows.shape[1]), np.float32)

    def ids(self, words: list) -> np.ndarray:
        if new := list(set(words).difference(self.known)):
            if self.used + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros((max(len(self.rows), len(new)), self.rows.shape[1]), np.float32)])
            self.rows[self.used : self.used + len(new)] = self.compute(new)
            self.known.update(zip(new, range(self.used, self.used + len(new))))
            self.used += len(new)
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
