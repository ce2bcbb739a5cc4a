"""Shared pieces: column picking, bounded Arrow batches, word patterns, connected components."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..session import materialise
from ..sources.tables import require_columns

# The white space of the contracts, [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Rows of one Arrow batch and bytes of text that Python code holds at once.
BATCH_ROWS = 2000
BATCH_BYTES = 8_000_000


def pick(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that further columns of the input can't clash."""
    return require_columns(df, columns).select(*columns)


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def arrow_map(df: DataFrame, fn, schema: str | ST.StructType) -> DataFrame:
    """``mapInArrow`` over batches of at most ``BATCH_ROWS`` rows, whatever the session has set."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fn(part for b in batches for part in slices(b))

    return df.mapInArrow(bounded, schema)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive pieces of at most ``BATCH_ROWS`` rows and about ``BATCH_BYTES`` bytes."""
    rows = batch.num_rows
    if not rows:
        return
    step = max(1, min(BATCH_ROWS, rows * BATCH_BYTES // max(batch.nbytes, 1)))
    for start in range(0, rows, step):
        yield batch.slice(start, step)


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes; ``bytes.lower`` and ``bytes.split`` follow the contracts' ASCII rules."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges(a, b)``: (node, root), root the least node reached.

    Alternating large and small stars, each a minimum per node that is combined
    before its shuffle and a join back to it, so that no neighbourhood is ever
    held together. Each round is written to the shared folder. Only nodes with
    an edge to another node are returned; an empty input gives an empty table.
    """
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    links = materialise(links, name)
    state = _digest(links)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        small = tied.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        links = materialise(small, name)
        before, state = state, _digest(links)
        if before == state:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _digest(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def packed(df: DataFrame, *beside: Column) -> DataFrame:
    """All columns in one struct ``row``, so that none can clash with what is joined, and further columns beside it."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *beside)


def unpacked(df: DataFrame, columns: Sequence[str], *beside: Column | str) -> DataFrame:
    return df.select(*[F.col(f"row.`{c}`") for c in columns], *beside)


def keep_by_id(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Documents whose id is in ``kept(doc_id)``, one row per id; rows without an id always stay.

    A left join, so that null ids, which never match, pass through.
    """
    marked = kept.select(F.col("doc_id").alias("id"), F.lit(True).alias("keep"))
    rows = packed(docs, F.col("doc_id").alias("own"))
    joined = rows.join(marked, F.col("own") == F.col("id"), "left")
    return unpacked(joined.where("own is null or keep"), docs.columns)


def first_rows(docs: DataFrame, order: str = "text") -> DataFrame:
    """One row for each doc_id (repeated rows of an id: the least by hash); rows without an id all stay."""
    rows = packed(docs, F.col("doc_id").alias("own"), F.xxhash64(order).alias("place"))
    number = F.row_number().over(Window.partitionBy("own").orderBy("place"))
    return unpacked(rows.withColumn("number", number).where("own is null or number = 1"), docs.columns)
