"""Mixing sources to target weights by capped water-filling and seeded repetition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import WORD, packed, unpacked

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 9


def word_count(text: str = "text"):
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, share: float = 1.0
) -> DataFrame:
    """(source, source_size, target) from ``sizes(source, source_size)``, one row per source.

    Sources in code point order (null last) get the weights in turn. The level
    is the target per unit of weight: sources it would lift above
    ``max_epochs`` times their size are clamped there and the level is raised
    for the rest, until none is above. Only the level reaches the driver.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    cap = F.col("source_size") * max_epochs
    ranked = materialise(sizes.withColumn("weight", weight).withColumn("cap", cap), "mix-sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        above = F.col("cap") < F.lit(level) * F.col("weight")
        held, free = ranked.agg(F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("weight")))).first()
        if not free:
            break
        raised = (total * share - (held or 0)) / free
        if raised <= level:
            break
        level = raised
    return ranked.select("source", "source_size", F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def mix(
    sized: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, share: float = 1.0, seed: int = SEED
) -> DataFrame:
    """Rows of ``sized`` (with doc_id, source, size) plus source_size, target, copies and taken.

    A source is repeated whole as often as its target holds it; the rest is
    filled with documents in the order of a seeded hash of doc_id, a document
    being taken if the middle of its words lies within the rest. The order is
    cut into 4096 buckets per source, so that only the rows of one bucket are
    ranked. Null sources are one source, null doc_ids share one hash, repeated
    rows are documents of their own. Sources without words have target 0.
    Columns of these four names in ``sized`` are replaced.
    """
    sized = sized.drop("source_size", "target", "copies", "taken")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")))
    bucket = F.conv(F.substring(key, 1, 3), 16, 10).cast("int")
    place = [F.col("doc_id"), F.col("source"), F.col("size"), key.alias("key"), bucket.alias("bucket")]
    narrow = materialise(sized.select(*place[1:3], place[4]), "mix-sizes")
    targets = source_targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs, share)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    running = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by_bucket = narrow.groupBy(F.col("source").alias("s"), "bucket").agg(F.sum("size").alias("n")).withColumn("until", F.sum("n").over(running))
    cut = targets.join(by_bucket, F.col("source").eqNullSafe(F.col("s"))).where("until - n <= rest")
    cut = cut.groupBy("s", "source_size", "target", "whole", "rest").agg(F.max(F.struct("bucket", F.expr("until - n").alias("before"))).alias("at"))
    cut = materialise(cut.select("s", "source_size", "target", "whole", "rest", F.col("at.bucket").alias("cut"), "at.before"), "mix-cuts")
    rows = packed(sized, *place).join(cut, F.col("source").eqNullSafe(F.col("s")))
    ranked = Window.partitionBy("s").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = rows.where("bucket = cut").withColumn("until", F.sum("size").over(ranked))
    edge = edge.withColumn("more", F.expr("before + until - size / 2.0D <= rest").cast("int")).drop("until")
    clear = rows.where("bucket <> cut").withColumn("more", F.expr("bucket < cut").cast("int"))
    mixed = clear.unionByName(edge).withColumn("copies", (F.col("whole") + F.col("more")).cast("long"))
    return unpacked(mixed, sized.columns, "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` (doc_id, text, source and more) with size in words and the columns of :func:`mix`; a null text has size 0."""
    return mix(docs.drop("size").withColumn("size", word_count()), **settings)


MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM src
), steps AS (
  SELECT *, row_number() OVER o AS k, sum(3 * source_size) OVER o - 3 * source_size AS held, sum(w) OVER () - (sum(w) OVER o - w) AS free,
    sum(source_size) OVER () AS total
  FROM ranked WINDOW o AS (ORDER BY 3.0 * source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), lvl AS (
  SELECT CAST(total - held AS DOUBLE) / free AS lift FROM steps
  WHERE 3 * source_size >= CAST(total - held AS DOUBLE) / free * w ORDER BY k LIMIT 1
), targets AS (
  SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), lift * w) AS target FROM ranked, lvl
), parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
    target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size AS rest FROM targets
), placed AS (
  SELECT doc_id, source, size, sum(size) OVER (PARTITION BY source ORDER BY md5('9:' || doc_id), doc_id, size ROWS UNBOUNDED PRECEDING) AS until FROM sized
)
SELECT p.doc_id, p.size, t.source_size, round(t.target, 3) AS target,
  CAST(p.size * (t.whole + CASE WHEN p.until - p.size / 2.0::DOUBLE <= t.rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed p JOIN parts t ON p.source IS NOT DISTINCT FROM t.source
"""
