"""Line deduplication over levelled sorted runs of line hashes.

The index is a set of runs: tables of (h1, h2, owner) bucketed and sorted by
the 128-bit hash of a line's key, with disjoint keys. A new batch is reduced to
its distinct keys, merge-anti-joined with every run, and what is left becomes a
run of level 0; when a level holds ``fanout`` runs they are compacted into one
run of the next level. Batches come in the order of doc_id, so the owner of a
key is the least doc_id that ever held it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, shared_dir
from .common import SPACES, arrow_map, ascii_lower, pick

MIN_CHARS = 10
BATCHES = 4
FANOUT = 3
BUCKETS = 24
KEY = ("h1", "h2")


class LineRuns:
    """Runs of line hashes in the shared folder; ``add`` takes one batch of ``(h1, h2, doc_id)``."""

    def __init__(self, spark: SparkSession, buckets: int = BUCKETS, fanout: int = FANOUT):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.runs: list[tuple[int, str]] = []

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        writer = rows.repartition(self.buckets, *KEY).write.bucketBy(self.buckets, *KEY).sortBy(*KEY)
        writer.option("path", f"{shared_dir(self.spark)}/{name}").format("parquet").saveAsTable(name)
        self.runs.append((level, name))

    def add(self, keys: DataFrame) -> None:
        """Keys no run holds yet become a run of level 0, owned by their least doc_id in the batch."""
        fresh = keys.groupBy(*KEY).agg(F.min("doc_id").alias("owner")).repartition(self.buckets, *KEY)
        for _, name in self.runs:
            fresh = fresh.join(self.spark.table(name).select(*KEY).hint("merge"), list(KEY), "left_anti")
        self._write(fresh, 0)
        self._compact()

    def _compact(self) -> None:
        level = 0
        while len(full := [r for r in self.runs if r[0] == level]) >= self.fanout:
            self.runs = [r for r in self.runs if r[0] != level]
            self._write(self._union(full), level + 1)
            for _, name in full:
                self.spark.sql(f"DROP TABLE {name}")
            level += 1

    def _union(self, runs: list[tuple[int, str]]) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.spark.table(name) for _, name in runs])

    def owners(self) -> DataFrame:
        """Every key with its owner, once."""
        return self._union(self.runs)


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, line, h1, h2) of the lines whose key has ``min_chars`` code points or more."""
    lines = docs.where("doc_id is not null").select(
        "doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line", "value")
    )
    key = ascii_lower(F.btrim("value", F.lit(SPACES)))
    return lines.select("doc_id", "line", key.alias("k")).where(F.length("k") >= min_chars).select(
        "doc_id", "line", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(1), "k").alias("h2")
    )


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES) -> DataFrame:
    """(doc_id, dropped): the numbers of the lines each document loses; documents that lose none are absent."""
    spark = docs.sparkSession
    keys = line_keys(docs, min_chars)
    shares = [i / batches for i in range(1, batches)]
    cuts = sorted(set((docs.agg(F.percentile_approx("doc_id", shares, 1000)).first()[0] if shares else None) or []))
    batch = reduce(lambda a, b: a + b, [(F.col("doc_id") > c).cast("int") for c in cuts], F.lit(0))
    keys = materialise(keys.withColumn("batch", batch), "line-keys")
    runs = LineRuns(spark)
    for b in range(len(cuts) + 1):
        runs.add(keys.where(F.col("batch") == b).select("doc_id", *KEY))
    later = keys.join(runs.owners(), list(KEY)).where("doc_id > owner")
    return later.groupBy("doc_id").agg(F.collect_set("line").alias("dropped"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES) -> DataFrame:
    """All columns of ``docs`` with the kept lines as ``text``, and ``n_lines`` and ``n_dropped``.

    A key (a line stripped and lower-cased) of ``min_chars`` code points or more
    that several documents hold stays only in the least doc_id, there on all its
    lines. Null and empty texts are one empty line. Rows that repeat a doc_id
    are one document and lose the same lines. Rows with a null doc_id own and
    lose nothing. An empty table gives an empty result.
    """
    drops = dropped_lines(pick(docs, "doc_id", "text"), min_chars, batches).select(F.col("doc_id").alias("id"), "dropped")
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns if c != "text"]).alias("others"), F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").alias("own")
    )
    joined = rows.join(drops, F.col("own") == F.col("id"), "left").select("others", "text", "dropped")

    def run(pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces:
            texts, totals, losses = [], [], []
            for text, dropped in zip(piece.column("text").to_pylist(), piece.column("dropped").to_pylist()):
                lines, gone = text.split("\n"), set(dropped or ())
                texts.append("\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text)
                totals.append(len(lines))
                losses.append(len(gone))
            yield pa.RecordBatch.from_arrays(
                [piece.column("others"), pa.array(texts, pa.string()), pa.array(totals, pa.int64()), pa.array(losses, pa.int64())],
                ["others", "text", "n_lines", "n_dropped"],
            )

    others_type = joined.schema["others"].dataType.simpleString()
    kept = arrow_map(joined, run, f"others {others_type}, text string, n_lines long, n_dropped long")
    return kept.select(*[F.col("text") if c == "text" else F.col(f"others.`{c}`") for c in columns], "n_lines", "n_dropped")
