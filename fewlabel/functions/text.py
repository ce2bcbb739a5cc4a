"""Text scalars as native column expressions (no Python worker involved).

Every regular expression below runs in linear time, also on long runs of
letters, blank lines or vowels, so one odd page cannot stall a task.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import words as W

# Token, sentence and layout patterns.
WORD = r"[A-Za-z]+(?:'[A-Za-z]+)?"
ALNUM = r"[A-Za-z0-9]+(?:'[A-Za-z]+)?"
HEADLINE_WORD = (
    r"[A-Za-z]+(?:'[A-Za-z]+)?"
    r"|[0-9]+(?:[,.][0-9]+)*(?:[sS][tT]|[nN][dD]|[rR][dD]|[tT][hH])?"
)
SENTENCE_END = r"[.!?]+"
BULLET = r"(?md)^[^\S\n]*[-*+]\s+\S"
NUMBERED = r"(?md)^[^\S\n]*[0-9]+[.)]\s+\S"
HEADING = r"(?md)^#{1,6}\s+\S"
BOLD = r"\*\*[^*]+\*\*"
LABEL_LINE = r"(?md)^[^\S\n]*[A-Z][A-Za-z0-9 /-]{2,}:[^\S\n]*$"
# White space as Unicode sees it, spelled out so that every engine agrees.
SPACE = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"



def _accent_table() -> tuple[str, str]:
    """Letters of the basic plane whose compatibility decomposition is one letter and marks, that letter; then all marks, for deletion."""
    pairs, marks = [], []
    for c in map(chr, range(0x300, 0x10000)):
        if unicodedata.combining(c):
            marks.append(c)
    for c in map(chr, range(0xC0, 0x10000)):
        plain = [x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)]
        if len(plain) == 1 and plain[0] != c and not 0xAC00 <= ord(c) <= 0xD7AF:
            pairs.append((c, plain[0]))
    return "".join(a for a, _ in pairs) + "".join(marks), "".join(b for _, b in pairs)


ACCENTED, UNACCENTED = _accent_table()


def _n(x) -> Column:
    return F.lit(x)


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, _n(pattern), _n(0))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, _n(pattern))


def safe_div(num: Column, den: Column) -> Column:
    return F.when(den != 0, num / den).otherwise(_n(0.0))


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, _n(""))


# --- counts ----------------------------------------------------------------


def words(text: Column) -> Column:
    return _all(text, WORD)


def word_count(text: Column) -> Column:
    return _count(text, WORD)


def token_count(text: Column) -> Column:
    return _count(text, ALNUM)


def char_count(text: Column) -> Column:
    return F.length(text)


def sentence_runs(text: Column) -> Column:
    return F.greatest(_n(1), _count(text, SENTENCE_END))


def sentence_parts(text: Column) -> Column:
    """Non-blank pieces between sentence ends; one match per piece."""
    return F.greatest(_n(1), _count(text, rf"[^.!?{SPACE}][^.!?]*"))


def occurrences(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


# --- tokens ----------------------------------------------------------------


def tokens(text: Column, keep_stop: bool = False, stop: Sequence[str] = W.STOP_WORDS) -> Column:
    found = _all(F.lower(text), ALNUM)
    return found if keep_stop else without(found, stop)


def headline_tokens(text: Column) -> Column:
    return _all(F.lower(text), HEADLINE_WORD)


def headline_words(text: Column) -> Column:
    """Headline tokens that hold a letter, lower case."""
    return F.filter(headline_tokens(text), lambda w: w.rlike("[a-z]"))


def without(tokens_: Column, stop: Sequence[str]) -> Column:
    return F.filter(tokens_, lambda w: ~w.isin(*stop))


def normalize_text(text: Column) -> Column:
    squeezed = F.regexp_replace(text_or_empty(text), f"[{SPACE}]+", " ")
    return F.trim(squeezed)


# --- syllables and readability ---------------------------------------------

_CONSONANTS = "bcdfghjklmnpqrstvwxz"


def syllables(word: Column) -> Column:
    """Syllables of one word: vowel groups, less a silent final e, at least 1."""
    letters = F.regexp_replace(F.lower(word), "[^a-z]", "")
    groups = _count(letters, "[aeiouy]+")
    silent = F.when(letters.endswith("e") & (groups > 1), 1).otherwise(0)
    return F.when(letters == "", 0).otherwise(F.greatest(_n(1), groups - silent))


def syllable_total(words_: Column) -> Column:
    """Sum of :func:`syllables` over a word array without a per-word lambda.

    Over the blank-joined words three counts give the sum: vowel groups, words
    whose final e is silent, and words without any vowel (which count as one).
    The possessive quantifiers keep each count linear in the text.
    """
    joined = F.replace(F.lower(F.array_join(words_, " ")), _n("'"), _n(""))
    groups = _count(joined, "[aeiouy]+")
    silent = _count(joined, f"[aeiouy][{_CONSONANTS}]++[aeiouy]++(?<=e)(?![a-z])")
    voiceless = _count(joined, f"(?<![a-z])[{_CONSONANTS}]++(?![a-z])")
    return groups - silent + voiceless


def reading_ease(n_words: Column, n_sentences: Column, n_syllables: Column) -> Column:
    score = (
        _n(206.835)
        - _n(1.015) * (n_words / F.greatest(n_sentences, _n(1)))
        - _n(84.6) * (n_syllables / n_words)
    )
    return F.when(n_words == 0, _n(0.0)).otherwise(score)


def fk_grade(n_words: Column, n_sentences: Column, n_syllables: Column) -> Column:
    score = (
        _n(0.39) * (n_words / F.greatest(n_sentences, _n(1)))
        + _n(11.8) * (n_syllables / n_words)
        - _n(15.59)
    )
    return F.when(n_words == 0, _n(0.0)).otherwise(score)


def letters_total(words_: Column) -> Column:
    return F.length(F.regexp_replace(F.array_join(words_, ""), "[^a-z]", ""))


# --- shares, presence, overlap ---------------------------------------------


def vocab_hits(words_: Column, vocabulary: Sequence[str]) -> Column:
    return F.size(F.filter(words_, lambda w: w.isin(*vocabulary)))


def vocab_share(words_: Column, vocabulary: Sequence[str]) -> Column:
    return safe_div(vocab_hits(words_, vocabulary), F.size(words_))


def has_vocab(words_: Column, vocabulary: Sequence[str]) -> Column:
    return F.arrays_overlap(words_, F.array(*[_n(v) for v in vocabulary])).cast("double")


def question(text: Column, words_: Column, starters: Sequence[str] = W.QUESTION_STARTERS) -> Column:
    starts = F.coalesce(F.try_element_at(words_, _n(1)).isin(*starters), _n(False))
    return (text.contains("?") | starts).cast("double")


def numeric(tokens_: Column, number_words: Sequence[str] = W.NUMBER_WORDS) -> Column:
    return F.exists(tokens_, lambda t: t.rlike("[0-9]") | t.isin(*number_words)).cast("double")


def coverage(needles: Column, haystack: Column) -> Column:
    """Share of the distinct needles found in the haystack; no needles -> 0."""
    distinct = F.array_distinct(needles)
    return safe_div(F.size(F.array_intersect(distinct, haystack)), F.size(distinct))


def jaccard(left: Column, right: Column) -> Column:
    return safe_div(F.size(F.array_intersect(left, right)), F.size(F.array_union(left, right)))


def uppercase_words(text: Column) -> Column:
    pieces = F.split(text, f"[{SPACE}]+")
    return F.size(
        F.filter(pieces, lambda p: (F.length(p) > 1) & (p == F.upper(p)) & (p != F.lower(p)))
    )


def punctuation_intensity(text: Column) -> Column:
    return _count(text, "[!?;:-]") / F.greatest(F.length(text), _n(1))


def structured_format(text: Column) -> Column:
    found = text.rlike(BULLET)
    for pattern in (NUMBERED, HEADING, BOLD, LABEL_LINE):
        found = found | text.rlike(pattern)
    return found.cast("double")


def fold_accents(text: Column) -> Column:
    return F.translate(text, ACCENTED, UNACCENTED)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")
