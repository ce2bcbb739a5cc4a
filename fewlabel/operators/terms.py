"""Word statistics of a corpus: frequencies, sentiment from a lexicon, TF-IDF.

Words are counted with map-side combining, terms of TF-IDF inside the row. Frequent words, which would make
hot join keys, are few by their definition (a share of 1/10000 each leaves at
most 10000), so they are joined by broadcast and only rare words are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..functions import text as T
from ..functions import words as V
from ..session import materialise

HEAVY_SHARE = 10_000


def word_frequencies(rows: DataFrame, words: str) -> DataFrame:
    counts = rows.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t")).scalar()
    return counts.withColumn("zipf", F.log10(F.lit(1e9) * F.col("n") / total)).withColumn("share", F.col("n") / total)


def corpus_zipf(
    rows: DataFrame, id_: str, words: str, stop: Sequence[str] = V.STOP_WORDS, rare: float = 3.5, common: float = 4.5
) -> DataFrame:
    """Mean Zipf value of all and of content words, rare and common shares, per row.

    The frequency table is this corpus itself. ``rows`` should be a stored
    table: it is read once for the counts and once for the averages.
    """
    freq = word_frequencies(rows, words)
    heavy = freq.where(F.col("share") * HEAVY_SHARE >= 1).select("word", F.col("zipf").alias("hz"))
    tokens = rows.select(id_, F.explode_outer(words).alias("word")).join(F.broadcast(heavy), "word", "left")
    known = tokens.where(F.col("hz").isNotNull() | F.col("word").isNull()).withColumnRenamed("hz", "zipf")
    light = tokens.where(F.col("hz").isNull() & F.col("word").isNotNull()).drop("hz").join(freq.select("word", "zipf"), "word")
    content = ~F.col("word").isin(*stop)
    sums = (
        known.select(id_, "word", "zipf")
        .unionByName(light.select(id_, "word", "zipf"))
        .groupBy(id_)
        .agg(
            F.count("word").alias("n"),
            F.sum("zipf").alias("z"),
            F.count(F.when(content, 1)).alias("nc"),
            F.sum(F.when(content, F.col("zipf"))).alias("zc"),
            F.count(F.when(content & (F.col("zipf") < rare), 1)).alias("n_rare"),
            F.count(F.when(F.col("zipf") >= common, 1)).alias("n_common"),
        )
    )
    div = T.safe_div
    return sums.select(
        id_,
        div(F.coalesce("z", F.lit(0.0)), F.col("n")).alias("common_zipf"),
        div(F.coalesce("zc", F.lit(0.0)), F.col("nc")).alias("content_common_zipf"),
        div(F.col("n_rare"), F.col("nc")).alias("rare_word_share"),
        div(F.col("n_common"), F.col("n")).alias("common_word_share"),
    )


def lexicon_sentiment(rows: DataFrame, id_: str, words: str, lexicon: DataFrame | None = None) -> DataFrame:
    """compound, pos, neg, neu per row from a (word, valence) table.

    compound = x / sqrt(x^2 + 15) for the valence sum x; pos and neg weigh each
    hit by its strength plus one, neu counts the words without valence. A row
    without words gets zeros.
    """
    if lexicon is None:
        lexicon = rows.sparkSession.createDataFrame(list(V.DEFAULT_LEXICON), "word string, valence double")
    tokens = rows.select(id_, F.explode_outer(words).alias("word"))
    # a lexicon of small estimated bytes is broadcast by the planner; beyond it frequent
    # words are split by the adaptive skew join, as the sums below shuffle anew
    hit = tokens.join(lexicon, "word", "left")
    v = F.coalesce(F.col("valence"), F.lit(0.0))
    sums = hit.groupBy(id_).agg(
        F.sum(v).alias("x"),
        F.sum(F.when(v > 0, v + 1).otherwise(0.0)).alias("p"),
        F.sum(F.when(v < 0, 1 - v).otherwise(0.0)).alias("m"),
        F.count(F.when((v == 0) & F.col("word").isNotNull(), 1)).alias("u"),
    )
    total = F.col("p") + F.col("m") + F.col("u")
    compound = F.col("x") / F.sqrt(F.col("x") * F.col("x") + 15)
    pos, neg = T.safe_div(F.col("p"), total), T.safe_div(F.col("m"), total)
    return sums.select(
        id_,
        compound.alias("compound"),
        pos.alias("pos"),
        neg.alias("neg"),
        T.safe_div(F.col("u"), total).alias("neu"),
        F.abs(compound).alias("intensity"),
        (pos + neg).alias("emotion"),
    )


# Fixed value: a term is a run of two or more letters, digits or underscores.
TERM = r"[\p{L}\p{N}_]{2,}"


def terms(text: Column) -> Column:
    """Words and neighbouring word pairs, lower case, accents folded."""
    one = F.regexp_extract_all(T.fold_accents(F.lower(text)), F.lit(TERM), F.lit(0))
    return one


def with_bigrams(one: Column) -> Column:
    n = F.size(one)
    pairs = F.zip_with(F.slice(one, 1, F.greatest(n - 1, F.lit(0))), F.slice(one, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(one, F.when(n > 1, pairs).otherwise(F.array().cast("array<string>")))


def term_counts(rows: DataFrame, id_: str, words: str) -> DataFrame:
    """(id, words), one row per document, from which vocabulary and weights count terms; a word holds no blank.

    ``rows`` should be a stored table: it is read once per pass. Terms are
    counted inside the row, so that neither the words nor the many distinct
    pairs of a document are shuffled. Only where an id repeats are the words of
    its rows brought together, a null between them, over which no pair reaches.
    """
    docs = rows.select(id_, F.col(words).alias("words"))
    if docs.groupBy(id_).count().where("count > 1").isEmpty():
        return docs
    closed = F.concat(F.coalesce("words", F.array().cast("array<string>")), F.array(F.lit(None).cast("string")))
    return materialise(docs.groupBy(id_).agg(F.flatten(F.collect_list(closed)).alias("words")), "documents")


TOKENS_AT_ONCE = 1 << 20  # of a batch, in one task


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray]]:
    """Runs of rows with at most ``TOKENS_AT_ONCE`` words (or one row), their words, and the row of each word."""
    for batch in batches:
        counts = np.asarray(batch.column("words").value_lengths().fill_null(0)).astype(np.int64)
        ends, start = np.cumsum(counts), 0
        while start < len(counts):
            before = ends[start] - counts[start]
            stop = max(start + 1, int(np.searchsorted(ends, before + TOKENS_AT_ONCE, "right")))
            part = batch.slice(start, stop - start)
            yield part, part.column("words").flatten(), np.repeat(np.arange(stop - start), counts[start:stop])
            start = stop


def _places(words: pa.Array, known: pa.Array) -> np.ndarray:
    """The place of each word among the known, -1 for others and nulls."""
    return np.asarray(pc.fill_null(pc.index_in(words, value_set=known, skip_nulls=True), -1)).astype(np.int64)


def _pairs(places: np.ndarray, row: np.ndarray, known: int) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring known words of a row: the row and the code of each pair, first place * known + second."""
    both = (places[:-1] >= 0) & (places[1:] >= 0) & (row[:-1] == row[1:])
    return row[:-1][both], (places[:-1] * known + places[1:])[both]


def _occurring(rows: np.ndarray, codes: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, code), in order, and how often each occurs; codes lie below ``span``."""
    found, n = np.unique(rows * span + codes, return_counts=True)
    return found // span, found % span, n


def vocabulary(counts: DataFrame, n_docs: int, max_features: int, min_df: int | Column) -> DataFrame:
    """Most frequent terms with enough documents, numbered, with smooth IDF; from :func:`term_counts`.

    Words are counted first. A pair is no more frequent, and in no more
    documents, than either of its words: only pairs of words with enough
    documents, each as frequent as the last of the first ``max_features`` words,
    can be among the most frequent terms, and only these are counted. Such words
    are ``max_features`` and ties at most.
    """
    enough = F.col("df") >= min_df
    context = counts.sparkSession.sparkContext
    # all words of a row, then its distinct ones: these count documents
    listed = F.posexplode_outer(F.concat("words", F.array_distinct("words"))).alias("pos", "term")
    each = counts.select(F.size("words").alias("size"), listed).where("term is not null")
    later = (F.col("pos") >= F.col("size")).cast("long")
    single = materialise(each.groupBy("term").agg(F.sum(1 - later).alias("tf"), F.sum(later).alias("df")).where(enough), "words")
    least = single.orderBy(F.col("tf").desc()).limit(max_features).agg(F.count(F.lit(1)).alias("n"), F.min("tf").alias("tf")).first()
    known = single.where(F.col("tf") >= (least["tf"] if least["n"] == max_features else 0)).select("term").collect()
    shared = context.broadcast(sorted(r["term"] for r in known))

    def count_pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.array(shared.value, pa.string())
        for _, flat, row in _slices(batches):
            rows, codes = _pairs(_places(flat, words), row, len(words))
            _, codes, n = _occurring(rows, codes, max(len(words), 1) ** 2)
            found, at, df = np.unique(codes, return_inverse=True, return_counts=True)
            tf = np.bincount(at, n, len(found)).astype(np.int64)
            first, second = (words.take(pa.array(c)) for c in (found // max(len(words), 1), found % max(len(words), 1)))
            term = pc.binary_join_element_wise(first, second, " ")
            yield pa.RecordBatch.from_arrays([term, pa.array(tf), pa.array(df.astype(np.int64))], ["term", "tf", "df"])

    parts = counts.select("words").mapInArrow(count_pairs, "term string, tf long, df long")
    pairs = parts.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df")).where(enough)
    top = single.unionByName(pairs).orderBy(F.col("tf").desc(), "term").limit(max_features)
    place = F.row_number().over(W.orderBy("term")) - 1  # max_features rows at most
    idf = F.log((F.lit(1) + n_docs) / (F.lit(1) + F.col("df"))) + 1
    return top.select("term", "tf", "df", place.cast("int").alias("idx"), idf.alias("idf"))


def tfidf(counts: DataFrame, id_: str, vocab: DataFrame) -> DataFrame:
    """L2-normalised weights as index and value arrays per document; one without a known term has no row.

    The vocabulary (bounded by max_features) goes to the tasks, which weigh each
    document where they read it: nothing is shuffled.
    """
    known = sorted((tuple(r["term"].split(" ", 1)), r["idx"], r["idf"]) for r in vocab.select("term", "idx", "idf").collect())
    shared = counts.sparkSession.sparkContext.broadcast(known)
    schema = ST.StructType(
        [counts.schema[id_], ST.StructField("idx", ST.ArrayType(ST.IntegerType())), ST.StructField("val", ST.ArrayType(ST.DoubleType()))]
    )

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sorted({w for term, *_ in shared.value for w in term})
        at = {w: i for i, w in enumerate(words)}
        # words have the codes -1, -2, ...; pairs those of their two places
        coded = [(at[t[0]] * len(words) + at[t[1]] if len(t) > 1 else -1 - at[t[0]], idx, idf) for t, idx, idf in shared.value]
        codes, idx, idf = (np.array(c, t) for c, t in zip(zip(*sorted(coded)), (np.int64, np.int64, float))) if coded else [np.zeros(0)] * 3
        list_of = pa.array(words, pa.string())
        weight = np.zeros(len(codes))
        weight[idx.astype(np.int64)] = idf
        for part, flat, row in _slices(batches):
            places = _places(flat, list_of)
            pair_rows, pairs = _pairs(places, row, len(words))
            some = places >= 0
            rows, seen = np.r_[row[some], pair_rows], np.r_[-1 - places[some], pairs]
            spot = np.minimum(np.searchsorted(codes, seen), max(len(codes) - 1, 0))
            hit = codes[spot] == seen if len(codes) else np.zeros(len(seen), bool)
            rows, cols, n = _occurring(rows[hit], idx[spot[hit]].astype(np.int64), max(len(weight), 1))
            if not len(rows):
                continue
            w = n * weight[cols]
            w /= np.sqrt(np.bincount(rows, w * w))[rows]
            docs, starts = np.unique(rows, return_index=True)
            offsets = pa.array(np.r_[starts, len(rows)], pa.int32())
            idxs = pa.ListArray.from_arrays(offsets, pa.array(cols, pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(id_).take(pa.array(docs)), idxs, pa.ListArray.from_arrays(offsets, pa.array(w))], [id_, "idx", "val"])

    return counts.select(id_, "words").mapInArrow(weigh, schema)
