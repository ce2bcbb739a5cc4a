"""Secrets in text: fixed patterns, and a linear-chain conditional random field that adds to them.

The field tags the tokens of a text as outside (0), begin (1) or inside (2) of a
secret. A token is a stretch of a word up to and with the punctuation that ends
it, so that names and values in addresses, one-line configuration and minified
JSON are tokens of their own. The score of a tag is a sum of hashed features of
the whole token (shape, length, classes of characters, alphabetic parts), of its
neighbours, and of the file (length, lines, digits). It is trained to the tags
that the patterns give on a bounded sample of windows, half around matches and
half from texts without, and decoded by Viterbi over whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import arrow_map, pick
from .texts import RowCache, add_columns

# The kinds of the base patterns in their order; further spans have the kind "crf".
KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("passw", "secret", "token", "api")
TOKENS = re.compile(r"""[^\x20\x09-\x0D"'`=:;,&?(){}\[\]<>|/\\]+["'`=:;,&?(){}\[\]<>|/\\]*|["'`=:;,&?(){}\[\]<>|/\\]+""")
TAIL = "\"'`=:;,&?(){}[]<>|/\\.!"  # what may end a token without being of its core
RUNS = re.compile(r"[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+")

# Parameters: hashed features, windows of either sort, tokens on either side of a match, steps and rates of the fit, forms kept in memory.
BITS = 18
WINDOWS = 1500
SIDE = 8
STEPS = 60
RATE = 0.3
RIDGE = 1e-3
MOST_TRANSITION = 2.0
TAGS = 3
FORMS = 100_000


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the base patterns, ordered."""
    found = []
    lower = text.lower()
    if any(k in lower for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def _hash(*keys: str) -> list[int]:
    mask = (1 << BITS) - 1
    return [crc32(k.encode()) & mask for k in keys]


def describe(token: str) -> tuple[tuple, list[str]]:
    """The form of a whole token (shape, length, runs, digits, variety, end) and its alphabetic parts.

    A token of up to six runs has them as its shape, a longer one the classes it
    mixes; parts are all runs of three or more letters in either case.
    """
    core = token.rstrip(TAIL)
    end, n = token[len(core) : len(core) + 1], len(core)
    size = min(n.bit_length(), 12)
    if core.isalpha():
        # plain words come in few forms
        shape = "a" if core.islower() else "A" if core.isupper() else "Aa" if core[:1].isupper() and core[1:].islower() else ""
        if shape:
            return (shape, size, 1, 0, -1, end), [core.lower()]
    runs = RUNS.findall(core)
    kinds = ["a" if r[0].islower() else "A" if r[0].isupper() else "0" if r[0].isdigit() else r[0] for r in runs]
    shape = "".join(kinds) if len(kinds) <= 6 else "mix" + "".join(sorted(set(kinds) & {"a", "A", "0"}))
    digits = 8 * sum([len(r) for r in runs if r[0].isdigit()]) // max(n, 1)
    varied = 8 * len(set(core)) // max(n, 1)
    return (shape, size, min(len(runs), 12), digits, varied, end), [p for p in {r.lower() for r in runs if r[0].isalpha()} if len(p) > 2]


def form_keys(form: tuple) -> tuple[list[int], list[int]]:
    """Hashed features of a form for the token's own tag, and those among them that its neighbours see."""
    shape, size, runs, digits, varied, end = form
    seen = _hash(f"s{shape}", f"l{size}", f"e{end}")
    return [*seen, *_hash("bias", f"r{runs}", f"d{digits}:{size}", f"v{varied}:{size}")], seen


def token_keys(token: str) -> tuple[list[int], list[int]]:
    """All hashed features of a token, for its own tag and for its neighbours' tags."""
    form, parts = describe(token)
    own, seen = form_keys(form)
    more = _hash(*["p" + p for p in parts])
    return own + more, seen + more


def file_keys(text: str) -> list[int]:
    """Hashed features of a text: its length, lines and digits."""
    digits = sum(text.count(d) for d in "0123456789")
    return _hash(f"fl{len(text).bit_length()}", f"fn{text.count(chr(10)).bit_length()}", f"fd{digits.bit_length()}")


def tags_of(places: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Tags of tokens (given by start and end) under the spans; overlapping spans are one."""
    tags = np.zeros(len(places), np.int8)
    at, until = 0, -1
    for start, _, end in spans:
        while at < len(places) and places[at][1] <= start:
            at += 1
        i, begun = at, start < until
        while i < len(places) and places[i][0] < end:
            if not tags[i]:
                tags[i] = 2 if begun else 1
            begun = True
            i += 1
        until = max(until, end)
    return tags


@dataclass
class Field:
    """Weights by hashed feature (a row: three tags of the token itself, of the next and of the previous one) and by (tag, next tag)."""

    weights: np.ndarray
    transition: np.ndarray

    def __post_init__(self):
        self.live = self.weights.any(axis=1).tobytes()
        self.forms: dict[tuple, int] = {}
        self.sums = np.empty((1024, 3 * TAGS), np.float32)

    def form(self, form: tuple) -> int:
        """The place of a form's row of sums, made once."""
        place = self.forms.get(form)
        if place is None:
            own, seen = form_keys(form)
            place = self.forms[form] = len(self.forms)
            if place == len(self.sums):
                self.sums = np.concatenate([self.sums, np.empty_like(self.sums)])
            self.sums[place, :TAGS] = self.weights[own, :TAGS].sum(axis=0)
            self.sums[place, TAGS:] = self.weights[seen, TAGS:].sum(axis=0)
        return place

    def rows(self, tokens: list[str]) -> np.ndarray:
        """Scores of the tags of each token itself, of the next token and of the previous one."""
        out = np.empty((len(tokens), 3 * TAGS), np.float32)
        mask, live = (1 << BITS) - 1, self.live
        for start in range(0, len(tokens), FORMS // 2):
            part = tokens[start : start + FORMS // 2]
            if len(self.forms) + len(part) > FORMS:
                self.forms.clear()
            places, at, keys = [], [], []
            for i, token in enumerate(part):
                form, alphabetic = describe(token)
                places.append(self.form(form))
                for p in alphabetic:
                    key = crc32(("p" + p).encode()) & mask
                    if live[key]:
                        at.append(start + i)
                        keys.append(key)
            out[start : start + len(part)] = self.sums[places]
            if at:
                np.add.at(out, at, self.weights[keys])
        return out

    def slack(self) -> float:
        """By how much transitions can favour another tag over outside at one token, at most."""
        t = np.zeros((TAGS + 1, TAGS + 1))  # the last row and column: the ends of the text
        t[:TAGS, :TAGS] = self.transition
        return max(t[p, s] + t[s, q] - t[p, 0] - t[0, q] for s in (1, 2) for p in range(TAGS + 1) for q in range(TAGS + 1))


def viterbi(scores: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """The best tags of one text; ties take the lower tag."""
    value, back = scores[0].astype(np.float64), np.zeros(scores.shape, np.int8)
    for t in range(1, len(scores)):
        options = value[:, None] + transition
        back[t] = options.argmax(axis=0)
        value = options.max(axis=0) + scores[t]
    path = np.zeros(len(scores), np.int8)
    path[-1] = value.argmax()
    for t in range(len(scores) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def windows(docs: DataFrame) -> DataFrame:
    """(doc_id, match, words, tags, file): a window around each base match, and one from each text without."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                text = text or ""
                spans = base_spans(text)
                words = TOKENS.findall(text)
                if not words:
                    continue
                if spans:
                    tags = tags_of([m.span() for m in TOKENS.finditer(text)], spans)
                    begins = np.flatnonzero(tags == 1).tolist()
                else:
                    tags, begins = np.zeros(len(words), np.int8), [crc32(str(doc_id).encode()) % len(words)]
                file = file_keys(text)
                for i in begins:
                    a, b = max(0, i - SIDE), i + SIDE + 1
                    out.append((doc_id, bool(spans), words[a:b], tags[a:b].tolist(), file))
            columns = list(zip(*out)) or [()] * 5
            types = [pa.int64(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "match", "words", "tags", "file"])

    return arrow_map(pick(docs, "doc_id", "text"), run, "doc_id long, match boolean, words array<string>, tags array<int>, file array<int>")


def train(docs: DataFrame, most: int = WINDOWS) -> Field:
    """Fit on at most ``most`` windows with a match and ``most`` without, first by a hash of id and words."""
    found = materialise(windows(docs), "secret-windows")  # read twice below
    order = F.xxhash64(F.lit("windows"), "doc_id", "words")
    parts = [found.where(w).orderBy(order, "doc_id").limit(most) for w in ("match", "not match")]
    rows = parts[0].unionByName(parts[1]).collect()  # at most 2 * most windows of 2 * SIDE + 1 tokens
    return fit([r["words"] for r in rows], [r["tags"] for r in rows], [r["file"] for r in rows])


def fit(words: list[list[str]], tags: list[list[int]], files: list[list[int]], steps: int = STEPS) -> Field:
    """Penalised maximum likelihood by Adagrad; the sums over all tag sequences by forward and backward passes."""
    table, transition = np.zeros((1 << BITS, 3 * TAGS), np.float32), np.zeros((TAGS, TAGS))
    if not words:
        table[_hash("bias"), 0] = 10.0
        return Field(table, transition)
    n, size = len(words), max(map(len, words))
    owner, index, real = [], [], np.zeros((n, size), bool)
    gold = np.zeros((n, size), np.int64)
    for i, (row, tag, file) in enumerate(zip(words, tags, files)):
        keys = [token_keys(w) for w in row]
        real[i, : len(row)], gold[i, : len(row)] = True, tag
        for t in range(len(row)):
            mine = [3 * k for k in [*keys[t][0], *file]]
            mine += [3 * k + 1 for k in keys[t - 1][1]] if t else []
            mine += [3 * k + 2 for k in keys[t + 1][1]] if t + 1 < len(row) else []
            owner += [i * size + t] * len(mine)
            index += mine
    # only features that occur have weights in the fit
    owner, (used, index) = np.array(owner), np.unique(index, return_inverse=True)
    weights = np.zeros((len(used), TAGS))
    onehot = np.eye(TAGS)[gold] * real[..., None]
    both = real[:, 1:] & real[:, :-1]
    pairs = np.einsum("ntp,ntq->pq", onehot[:, :-1] * both[..., None], onehot[:, 1:])
    squares, t_squares = np.full_like(weights, 1e-6), np.full_like(transition, 1e-6)
    for _ in range(steps):
        scores = np.stack([np.bincount(owner, weights[index, k], n * size) for k in range(TAGS)], axis=1).reshape(n, size, TAGS)
        scores = np.where(real[..., None], scores, [0.0, -1e4, -1e4])
        trans = np.where(both[..., None, None], transition, 0.0)
        ahead, behind = np.zeros((n, size, TAGS)), np.zeros((n, size, TAGS))
        ahead[:, 0] = scores[:, 0]
        for t in range(1, size):
            ahead[:, t] = np.logaddexp.reduce(ahead[:, t - 1, :, None] + trans[:, t - 1], axis=1) + scores[:, t]
        for t in range(size - 2, -1, -1):
            behind[:, t] = np.logaddexp.reduce(trans[:, t] + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        chance = np.exp(ahead + behind - total[:, None, None]) * real[..., None]
        joint = np.exp(ahead[:, :-1, :, None] + trans + (scores[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None])
        slope = ((chance - onehot) / n).reshape(-1, TAGS)
        g = np.stack([np.bincount(index, slope[owner, k], len(used)) for k in range(TAGS)], axis=1) + RIDGE * weights / n
        g_t = (np.einsum("ntpq->pq", joint * both[..., None, None]) - pairs) / n
        squares += g * g
        t_squares += g_t * g_t
        weights -= RATE * g / np.sqrt(squares)
        transition = np.clip(transition - RATE * g_t / np.sqrt(t_squares), -MOST_TRANSITION, MOST_TRANSITION)
    table.reshape(-1, TAGS)[used] = weights
    return Field(table, transition)


def field_spans(text: str, tags: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of tagged tokens without the tokens that base spans touch."""
    places = [m.span() for m in TOKENS.finditer(text)]
    free = tags_of(places, base) == 0
    out, last = [], -2
    for i in np.flatnonzero((tags > 0) & free).tolist():
        start, end = places[i]
        end = max(start + len(text[start:end].rstrip(TAIL)), start) or end
        if tags[i] == 2 and i == last + 1 and out:
            out[-1] = (out[-1][0], 3, max(end, out[-1][2]))
        else:
            out.append((start, 3, end))
        last = i
    return [x for x in out if any(c.isalnum() for c in text[x[0] : x[2]])]


def scan(docs: DataFrame, field: Field) -> DataFrame:
    """``docs`` with n_assign, n_access, n_hex, base_sha256 and spans of every text; null texts are empty.

    Spans of the field are added with kind "crf". They reach from the start of
    their first token to the end of the core of the last; tokens that a base span
    touches are cut out of them, and what is left on either side stays if it has
    a letter or digit. Ties between tags stay outside. Repeated rows and null ids are scanned like others, an empty
    table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast((field.weights, field.transition))

    def make() -> Callable:
        own = Field(*shared.value)
        cache, slack = RowCache(own.rows, 3 * TAGS), own.slack()

        def added(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
            words = TOKENS.findall(text)
            if not words:
                return []
            cache.start()
            ids = cache.ids(words)
            rows = cache.rows[ids]
            scores = rows[:, :TAGS] + own.weights[file_keys(text), :TAGS].sum(axis=0)
            scores[1:] += rows[:-1, TAGS : 2 * TAGS]
            scores[:-1] += rows[1:, 2 * TAGS :]
            # where outside leads by more than all transitions can undo, the best path is outside
            unsure = scores[:, 0] - scores[:, 1:].max(axis=1) <= slack
            if not unsure.any():
                return []
            tags = np.zeros(len(words), np.int8)
            # sure tokens cut the text into parts that don't depend on one another; each is decoded with its sure neighbours
            edges = np.flatnonzero(np.diff(np.concatenate(([False], unsure, [False])).astype(np.int8)))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                left, right = max(a - 1, 0), min(b + 1, len(words))
                part = scores[left:right].copy()
                if left < a:
                    part[0, 1:] = -1e6
                if right > b:
                    part[-1, 1:] = -1e6
                tags[a:b] = viterbi(part, own.transition)[a - left : a - left + b - a]
            if not tags.any():
                return []
            return field_spans(text, tags, base)

        def compute(texts: list) -> list[list]:
            out = []
            for text in texts:
                base = base_spans(text or "")
                count = [sum(kind == k for _, kind, _ in base) for k in range(3)]
                every = sorted(base + added(text or "", base))
                out.append((*count, sha256(said(base).encode()).hexdigest(), said(every)))
            return [list(c) for c in zip(*out)]

        return compute

    new = {"n_assign": "long", "n_access": "long", "n_hex": "long", "base_sha256": "string", "spans": "string"}
    return add_columns(docs, make, new, binary=False)


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row of ``docs(doc_id, text)``."""
    docs = pick(docs, "doc_id", "text")
    return scan(docs, train(docs)).drop("text")
