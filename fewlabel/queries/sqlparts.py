"""SQL fragments for the checks, written independently of the Spark code; only the word lists are shared."""

from __future__ import annotations

from ..functions import words as W

# Token patterns and Unicode white space, written out here so that a wrong one elsewhere shows.
WORD = r"[A-Za-z]+(?:'[A-Za-z]+)?"
ALNUM = r"[A-Za-z0-9]+(?:'[A-Za-z]+)?"
HEADLINE_WORD = r"[A-Za-z]+(?:'[A-Za-z]+)?|\d+(?:[,.]\d+)*(?:st|ST|nd|ND|rd|RD|th|TH|sT|St|nD|Nd|rD|Rd|tH|Th)?"
SPACE = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def found(text: str, pattern: str) -> str:
    return f"regexp_extract_all({text}, {lit(pattern)})"


def n_found(text: str, pattern: str) -> str:
    return f"len({found(text, pattern)})"


def words(text: str) -> str:
    return found(text, WORD)


def tokens(text: str, keep_stop: bool = False) -> str:
    got = found(f"lower({text})", ALNUM)
    return got if keep_stop else f"list_filter({got}, lambda t: t NOT IN {in_list(W.STOP_WORDS)})"


def headline_words(text: str) -> str:
    return f"list_filter({found(f'lower({text})', HEADLINE_WORD)}, lambda t: regexp_matches(t, '[a-z]'))"


def syllables(word: str) -> str:
    """One word at a time, unlike the Spark side, which counts over the whole text."""
    z = f"regexp_replace(lower({word}), '[^a-z]', '', 'g')"
    g = f"len(regexp_extract_all({z}, '[aeiouy]+'))"
    return f"(CASE WHEN {z} = '' THEN 0 ELSE greatest(1, {g} - CASE WHEN {z} LIKE '%e' AND {g} > 1 THEN 1 ELSE 0 END) END)"


def syllable_total(words_: str) -> str:
    return f"coalesce(list_sum(list_transform({words_}, lambda w: {syllables('w')})), 0)"


def sentence_runs(text: str) -> str:
    return f"greatest(1, {n_found(text, '[.!?]+')})"


def sentence_parts(text: str) -> str:
    return (
        f"greatest(1, len(list_filter(string_split_regex({text}, '[.!?]+'), "
        f"lambda p: regexp_matches(p, {lit('[^' + SPACE + ']')}))))"
    )


def reading_ease(n: str, s: str, syl: str) -> str:
    return f"(CASE WHEN {n} = 0 THEN 0.0 ELSE 206.835 - 1.015 * ({n}::DOUBLE / {s}) - 84.6 * ({syl}::DOUBLE / {n}) END)"


def fk_grade(n: str, s: str, syl: str) -> str:
    return f"(CASE WHEN {n} = 0 THEN 0.0 ELSE 0.39 * ({n}::DOUBLE / {s}) + 11.8 * ({syl}::DOUBLE / {n}) - 15.59 END)"


def div(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN 0.0 ELSE ({a})::DOUBLE / ({b}) END)"


# One row per distinct text (lowest id), and the labelled part of it with the
# two linear features used by the experiments.
CLEAN = """clean AS (
  SELECT doc_id, text, lang, source, n_chars FROM (
    SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn
    FROM documents WHERE text IS NOT NULL) WHERE rn = 1)"""

POP = CLEAN + f""",
pop_words AS (
  SELECT c.doc_id AS id, l.quality::DOUBLE AS y, l.toxic::DOUBLE AS toxic, c.lang, c.source, c.n_chars, c.text,
         {words('c.text')} AS w
  FROM clean c JOIN labels l ON c.doc_id = l.doc_id WHERE l.quality IS NOT NULL),
pop AS (
  SELECT id, y, toxic, lang, source, n_chars, text, ln(1 + len(w)) AS x1,
         {reading_ease('len(w)', sentence_runs('text'), syllable_total('w'))} / 100 AS x2
  FROM pop_words)"""

PAIRS = """pairs AS (
  SELECT a.doc_id // 2 AS pair_id, a.text AS headline_a, b.text AS headline_b, a.source AS lede_a, b.source AS lede_b,
         b.text AS excerpt_a, a.text AS excerpt_b
  FROM documents a JOIN documents b ON a.doc_id % 2 = 0 AND b.doc_id = a.doc_id + 1)"""

PREF = """turns AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations),
pref AS (
  SELECT u.conv_id, u.text AS prompt, r1.text AS response_1, r2.text AS response_2,
    greatest(-3.0, least(3.0, round_even((length(r2.text) - length(r1.text)) / 300.0, 0)))::DOUBLE AS preference_strength,
    CASE WHEN ('0x' || substr(md5('7:split:' || u.conv_id), 1, 15))::BIGINT % 5 = 0 THEN 'validation' ELSE 'train' END AS split
  FROM turns u JOIN turns r1 ON u.conv_id = r1.conv_id AND r1.role = 'assistant' AND r1.k = 1
  JOIN turns r2 ON u.conv_id = r2.conv_id AND r2.role = 'assistant' AND r2.k = 2
  WHERE u.role = 'user' AND u.k = 1)"""

# Layout patterns.
_FORMATS = (
    r"(?m)^\s*[-*+]\s+\S", r"(?m)^\s*\d+[\.)]\s+\S", r"(?m)^#{1,6}\s+\S", r"\*\*[^*]+\*\*",
    r"(?m)^\s*[A-Z][A-Za-z0-9 /-]{2,}:\s*$",
)


def structured(text: str) -> str:
    return "(CASE WHEN " + " OR ".join(f"regexp_matches({text}, {lit(p)})" for p in _FORMATS) + " THEN 1.0 ELSE 0.0 END)"


def coverage(a: str, b: str) -> str:
    return div(f"len(list_intersect(list_distinct({a}), list_distinct({b})))", f"len(list_distinct({a}))")


PREF_DELTA = PREF + f""",
pref_delta AS (
  SELECT *, preference_strength AS y,
    ln(1 + w2) - ln(1 + w1) AS delta_log_length, c2 - c1 AS delta_prompt_coverage,
    f2 - f1 AS delta_format, ln(1 + s2) - ln(1 + s1) AS delta_log_sentences
  FROM (SELECT conv_id, split, preference_strength,
    {n_found('response_1', ALNUM)} AS w1, {n_found('response_2', ALNUM)} AS w2,
    {sentence_runs('response_1')} AS s1, {sentence_runs('response_2')} AS s2,
    {coverage(tokens('prompt'), tokens('response_1'))} AS c1, {coverage(tokens('prompt'), tokens('response_2'))} AS c2,
    {structured('response_1')} AS f1, {structured('response_2')} AS f2 FROM pref)),
pref_frame AS (
  SELECT conv_id, split, y, {', '.join(d + ', CASE WHEN stddev_pop(' + d + ') OVER () > 0 THEN ' + d + ' / stddev_pop(' + d + ') OVER () ELSE 0.0 END AS ' + d + '_scale' for d in ('delta_log_length', 'delta_prompt_coverage', 'delta_format', 'delta_log_sentences'))}
  FROM pref_delta)"""

ORD = """ord AS (
  SELECT l_orderkey AS id, sum(l_extendedprice) / 1000 AS y, count(*)::DOUBLE AS x1, sum(l_quantity) / 10 AS x2
  FROM lineitem GROUP BY l_orderkey),
ord_n AS (SELECT count(*) AS n FROM ord),
ord_split AS (
  SELECT id, y, x1, x2, CASE WHEN r <= round_even(n * 0.32, 0) THEN 'h_scale' WHEN r <= round_even(n * 0.8, 0) THEN 'target' ELSE 'unused' END AS split
  FROM (SELECT *, row_number() OVER (ORDER BY md5('11:population:' || id), id) AS r FROM ord), ord_n)"""
