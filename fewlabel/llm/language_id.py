"""Language spans of mixed text: script ranges, per-word scores and Viterbi with a switching penalty.

Words are scored by letter n-grams (2 to 4, with word edges) counted per
language over the labelled texts and hashed into a table of fixed size. The
script of a word narrows the languages it may have: a language is a candidate
for a script if a share of its training letters is written in it. Viterbi finds
the best sequence of languages, each change costing ``SWITCH``; the language
with most letters is the prediction.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, pick
from .texts import RowCache, add_columns

# Parameters: hashed n-grams, cost of a change, least share of a script in a
# language, evidence a word can give at most, cost of a language that a word's
# script rules out (more than two changes), words counted before a flush, words hashed at once, an odd factor of the hash, words decoded at once.
BITS = 16
SWITCH = 8.0
SCRIPT_SHARE = 0.001
WORD_LIMIT = 6.0
RULED_OUT = 40.0
FLUSH = 200_000
CHUNK = 20_000
MIX = np.uint32(0x9E3779B1)
DECODED_WORDS = 1_000_000

# First and last code point of the letters of each script, after the Unicode blocks.
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "armenian": ((0x531, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x77F),),
    "devanagari": ((0x900, 0x97F),),
    "bengali": ((0x980, 0x9FF),),
    "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF),),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF)),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
}
SCRIPT_NAMES = (*SCRIPTS, "other")


def script_of(letters: str) -> int:
    """Number of the script most letters belong to; the first of equals."""
    if letters.isascii():
        return 0
    counts = [0] * len(SCRIPT_NAMES)
    for c in letters:
        counts[_script_of_letter(c)] += 1
    return counts.index(max(counts))


@lru_cache(4096)
def _script_of_letter(letter: str) -> int:
    at = ord(letter)
    return next((i for i, ranges in enumerate(SCRIPTS.values()) if any(a <= at <= b for a, b in ranges)), len(SCRIPTS))


def letters_of(word: str) -> str:
    word = word.lower()
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def grams(letters: list[str], bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashed n-grams of many words' letters, their edges marked by blanks.

    For each n the places of all n-grams, word by word, and where each word's begin (and the last one's end).
    """
    code = np.frombuffer("".join([f" {w} " for w in letters]).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, letters), np.int64, len(letters)) + 2
    starts = np.cumsum(sizes) - sizes
    hashed, out = np.zeros(len(code), np.uint32), []
    for n in range(1, 5):
        hashed = hashed[: len(code) - n + 1] * MIX + code[n - 1 :]
        if n == 1:
            continue
        counts = np.maximum(sizes - n + 1, 0)
        begin = np.concatenate(([0], np.cumsum(counts)))
        at = np.arange(begin[-1]) + np.repeat(starts - begin[:-1], counts)
        out.append((((hashed[at] ^ np.uint32(n)) * MIX >> np.uint32(32 - bits)).astype(np.int64), begin))
    return out


def held_out(doc_id: Column, of: int = 4, remainder: int = 2) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of == remainder


@dataclass
class Languages:
    """Log probabilities by (n-gram, language), candidates by (script, language)."""

    names: list[str]
    table: np.ndarray
    candidates: np.ndarray
    bits: int

    def __post_init__(self):
        # of a script: the mask of its languages, None where it rules none or all of them out
        self.narrowed = [row if row.any() and not row.all() else None for row in self.candidates]

    def words(self, words: list[str]) -> np.ndarray:
        """A row per word: score for each language (differences to the best, limited), then the number of letters.

        Languages that the word's script rules out cost ``RULED_OUT``, beyond the
        limit of evidence, so that a single word of another script is a span of
        its own. Words without letters give no evidence.
        """
        letters = [letters_of(w) for w in words]
        score = np.zeros((len(words), len(self.names)))
        for place, begin in grams(letters, self.bits):
            sums = np.concatenate([np.zeros((1, score.shape[1])), np.cumsum(self.table[place], axis=0, dtype=np.float64)])
            score += sums[begin[1:]] - sums[begin[:-1]]
        out = np.zeros(score.shape, bool)
        for i, w in enumerate(letters):
            if (allowed := self.narrowed[script_of(w)] if w else None) is not None:
                out[i] = ~allowed
        score[out] = -np.inf
        if len(words):
            score = np.maximum(score - score.max(axis=1, keepdims=True), -WORD_LIMIT)
        score[out] = -RULED_OUT
        sizes = np.fromiter(map(len, letters), np.float64, len(letters))
        score[sizes == 0] = 0
        return np.column_stack([score, sizes])


def counts(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """(lang, kind, place, n): n-gram counts (kind 0) and letters by script (kind 1) over ``docs(text, lang)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, counted in words.items():
                table, scripts = np.zeros(1 << bits, np.int64), np.zeros(len(SCRIPT_NAMES), np.int64)
                pairs = [(w, n) for w, n in ((letters_of(w), n) for w, n in counted.items()) if w]
                for a in range(0, len(pairs), CHUNK):
                    letters, times = zip(*pairs[a : a + CHUNK])
                    for place, begin in grams(list(letters), bits):
                        table += np.bincount(place, np.repeat(times, np.diff(begin)), 1 << bits).astype(np.int64)
                for letters, n in pairs:
                    scripts[script_of(letters)] += n * len(letters)
                for kind, array in enumerate((table, scripts)):
                    place = np.flatnonzero(array)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(place), pa.string()), pa.array(np.full(len(place), kind, np.int32)), pa.array(place.astype(np.int32)), pa.array(array[place])],
                        ["lang", "kind", "place", "n"],
                    )
            words.clear()

        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                words.setdefault(lang, Counter()).update((text or "").split())
            if sum(map(len, words.values())) > FLUSH:
                yield from flush()
        yield from flush()

    rows = arrow_map(pick(docs, "text", "lang"), run, "lang string, kind int, place int, n long")
    return rows.groupBy("lang", "kind", "place").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, bits: int = BITS) -> Languages:
    """Count over all rows of ``docs(text, lang)`` with a language; the table has 2**bits rows per language at most."""
    got = counts(pick(docs, "text", "lang").where("lang is not null"), bits).toArrow()
    lang = np.array(got.column("lang").to_pylist(), object)
    names = sorted(set(lang.tolist()))
    number = np.array([names.index(x) for x in lang], np.int64)
    kind, place, n = (got.column(c).to_numpy() for c in ("kind", "place", "n"))
    table, scripts = np.zeros((1 << bits, len(names))), np.zeros((len(SCRIPT_NAMES), len(names)))
    for array, k in ((table, 0), (scripts, 1)):
        np.add.at(array, (place[kind == k], number[kind == k]), n[kind == k])
    total = table.sum(axis=0)
    log = np.log(table + 0.5) - np.log(total + 0.5 * (1 << bits))
    share = scripts / np.maximum(scripts.sum(axis=0), 1)
    return Languages(names, log.astype(np.float32), share >= SCRIPT_SHARE, bits)


def decode(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Viterbi for many texts side by side: the best language of every word.

    ``scores`` has the words of all texts one after the other, ``lengths`` the
    texts' numbers of words. Texts are stepped together from the longest, ties
    stay in the language they are in and start in the first one.
    """
    order = np.argsort(-lengths, kind="stable")
    size, longest = scores.shape[1], int(lengths.max(initial=0))
    # words in the order they are stepped over: all first words, all second words and so on
    alive = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(longest), side="right")
    begin = np.concatenate(([0], np.cumsum(alive)))
    rank = np.empty(len(lengths), np.int64)
    rank[order] = np.arange(len(lengths))
    number = np.arange(len(scores)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    place = begin[number] + np.repeat(rank, lengths)
    stepped = np.empty_like(scores)
    stepped[place] = scores
    back = np.empty(scores.shape, np.int8 if size < 128 else np.int32)
    value, own, rows = np.zeros((len(lengths), size), np.float32), np.arange(size), np.arange(len(lengths))
    for t in range(longest):
        now = value[: alive[t]]
        if t:
            top = (now.max(axis=1) - switch)[:, None]
            change = top > now
            back[begin[t] : begin[t + 1]] = np.where(change, now.argmax(axis=1)[:, None], own)
            np.maximum(now, top, out=now)
        now += stepped[begin[t] : begin[t + 1]]
    path, state = np.empty(len(scores), np.int64), value.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        here = state[: alive[t]]
        path[begin[t] : begin[t + 1]] = here
        if t:
            state[: alive[t]] = back[begin[t] : begin[t + 1]][rows[: alive[t]], here]
    return path[place]


def label(docs: DataFrame, model: Languages, switch: float = SWITCH, spans: bool = False) -> DataFrame:
    """``docs`` with lang_pred and score, the share of the letters that its spans hold; with ``spans`` also the spans.

    ``lang_spans`` reads language:first word:last word, comma-joined. Null texts
    and texts without a letter are ``und`` with score 0, and so are all texts if
    nothing was learned. Words are split at white space. Repeated rows and null
    ids are labelled like others; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.names, model.table, model.candidates, model.bits))

    def make() -> Callable:
        names, table, candidates, bits = shared.value
        own = Languages(names, table, candidates, bits)
        cache = RowCache(own.words, len(names) + 1)

        def part(texts: list[list[str]]) -> Iterator[tuple[str, float, str]]:
            lengths = np.array([len(w) for w in texts], np.int64)
            cache.start()
            ids = cache.ids([w for words in texts for w in words])
            scores, weight = cache.rows[ids, :-1], cache.rows[ids, -1]
            path, end = decode(scores, lengths, switch), 0
            for n in lengths.tolist():
                start, end = end, end + n
                held = np.bincount(path[start:end], weight[start:end], len(names))
                if not held.sum():
                    yield "und", 0.0, ""
                    continue
                best = int(held.argmax())
                said = ""
                if spans:
                    cuts = np.flatnonzero(np.diff(path[start:end])) + 1
                    edges = [0, *cuts.tolist(), n]
                    said = ",".join(f"{names[path[start + a]]}:{a}:{b - 1}" for a, b in zip(edges, edges[1:]))
                yield names[best], float(held[best] / held.sum()), said

        def compute(texts: list) -> list[list]:
            split = [(t or "").split() if names else [] for t in texts]
            out, group, size = [], [], 0
            for words in split:
                if group and size + len(words) > DECODED_WORDS:
                    out += part(group)
                    group, size = [], 0
                group.append(words)
                size += len(words)
            if group:
                out += part(group) if names else [("und", 0.0, "")] * len(group)
            columns = [list(c) for c in zip(*out)]
            return columns if spans else columns[:2]

        return compute

    new = {"lang_pred": "string", "score": "double"} | ({"lang_spans": "string"} if spans else {})
    return add_columns(docs, make, new, binary=False)


def predict(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from the rows that are not held out, applied to all."""
    docs = pick(docs, "doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    model = train(docs.where("not held_out"))
    return label(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
