"""Byte-level BPE: texts to token ids and back, by a given table of ranks.

A text is cut by the vocabulary's pattern. Each piece starts as single bytes;
a segment tree over their positions holds, for each live part, the rank of the
pair it forms with the live part after it, and in every inner node the least
rank below. The leftmost least pair is found by walking down from the root; a
merge takes the right part out and renews the leaves of its live neighbours,
so a piece of n bytes costs O(n log n) however long it is. The trees of short
pieces are rows of one array and are stepped side by side; distinct pieces are
remembered up to a fixed number.

The vocabulary file is read on the driver and broadcast: its size is fixed by
the vocabulary (about a megabyte for 50,000 tokens), not by the texts.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map
from .texts import add_columns, with_fields

NO_PAIR = (1 << 31) - 1
HELD_PIECES = 200_000  # distinct pieces a task remembers, about 40 MB
CHUNK_CHARS = 1_000_000  # of text cut into pieces at once
WIDEST = 64  # pairs of the pieces whose trees are stepped side by side


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and rank of each line of a tiktoken file."""
    lines = (line.split() for line in Path(path).read_bytes().splitlines())
    return {base64.b64decode(token): int(rank) for token, rank in filter(None, lines)}


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece: itself if it is a token, else its bytes after all merges."""
    if piece in ranks:
        return [ranks[piece]]
    n, rank_of = len(piece), ranks.get
    # leaf ``size + i`` is the rank of the pair that starts at byte i, node k the least of nodes 2k and 2k + 1
    size = 1 << max(n - 2, 0).bit_length()
    least = [NO_PAIR] * (2 * size)
    least[size : size + n - 1] = [rank_of(piece[i : i + 2], NO_PAIR) for i in range(n - 1)]
    for node in range(size - 1, 0, -1):
        left, right = least[2 * node], least[2 * node + 1]
        least[node] = left if left <= right else right
    # live neighbours: where the part after and before each live part starts
    after, before = list(range(1, n + 2)), list(range(-1, n + 1))
    while least[1] != NO_PAIR:
        node = 1
        while node < size:
            node *= 2
            if least[node] > least[node + 1]:
                node += 1
        i = node - size
        gone = after[i]
        end = after[i] = after[gone]
        before[end] = i
        changed = [(node, rank_of(piece[i : after[end]], NO_PAIR) if end < n else NO_PAIR)]
        if gone < n - 1:
            changed.append((gone + size, NO_PAIR))
        if (h := before[i]) >= 0:
            changed.append((h + size, rank_of(piece[h:end], NO_PAIR)))
        for node, rank in changed:
            least[node] = rank
            while node > 1:
                node >>= 1
                left, right = least[2 * node], least[2 * node + 1]
                low = left if left <= right else right
                if least[node] == low:
                    break
                least[node] = low
    ids, i = [], 0
    while i < n:
        part = piece[i : after[i]]
        if part not in ranks:
            raise ValueError(f"the vocabulary has no token for byte {part!r}")
        ids.append(ranks[part])
        i = after[i]
    return ids


class PairRanks:
    """Rank of the token that two tokens form, for arrays of pairs of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        known = [(ranks[t[:k]] << 32 | ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        keys, values = np.array(known, np.int64).reshape(-1, 2).T
        order = np.argsort(keys)
        self.keys, self.values = np.append(keys[order], -1), np.append(values[order], NO_PAIR).astype(np.int32)
        self.bytes = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int32)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys[:-1], pair)
        return np.where(self.keys[at] == pair, self.values[at], NO_PAIR)


def encode_alike(pieces: list[bytes], pairs: PairRanks, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of pieces of at most ``size + 1`` bytes, one after the other, and how many each has.

    The same trees as in :func:`encode_piece`, one row each; in every step all
    pieces that have a pair left make their next merge.
    """
    n = np.fromiter(map(len, pieces), np.int64, len(pieces))
    place = np.arange(size + 2)
    live = place < n[:, None]
    ids = np.zeros(live.shape, np.int32)
    ids[live] = pairs.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
    if (ids[live] < 0).any():
        raise ValueError("the vocabulary lacks a token for some byte")
    after, before = np.tile(place + 1, (len(n), 1)), np.tile(place - 1, (len(n), 1))
    # node 0 lies outside the tree and takes the updates of places that have no leaf
    least = np.full((len(n), 2 * size), NO_PAIR, np.int32)
    row, at = np.nonzero(live[:, 1 : size + 1])
    least[row, size + at] = pairs.of(ids[row, at], ids[row, at + 1])
    level = size
    while level > 1:
        level //= 2
        least[:, level : 2 * level] = np.minimum(least[:, 2 * level : 4 * level : 2], least[:, 2 * level + 1 : 4 * level : 2])
    row = np.flatnonzero(least[:, 1] < NO_PAIR)
    while len(row):
        node = np.ones(len(row), np.int64)
        while node[0] < size:
            node *= 2
            node += least[row, node] > least[row, node + 1]
        i, token = node - size, least[row, 1]
        gone = after[row, i]
        end, h = after[row, gone], before[row, i]
        after[row, i], before[row, end], ids[row, i], live[row, gone] = end, i, token, False
        right = np.where(end < n[row], pairs.of(token, ids[row, end]), NO_PAIR)
        left = np.where(h >= 0, pairs.of(ids[row, h], token), NO_PAIR)
        changed = [(node, right), (np.where(gone < size, gone + size, 0), NO_PAIR), (np.where(h >= 0, h + size, 0), left)]
        for node, rank in changed:
            least[row, node] = rank
        for node, _ in changed:
            for _ in range(size.bit_length() - 1):
                node = node >> 1
                least[row, node] = np.minimum(least[row, 2 * node], least[row, 2 * node + 1])
        row = row[least[row, 1] < NO_PAIR]
    return ids[live], live.sum(axis=1)


class Encoder:
    """Texts to ids; each distinct piece is encoded once until ``HELD_PIECES`` are held."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pairs, self.cut = ranks, PairRanks(ranks), regex.compile(pattern).findall
        self.forget()

    def forget(self) -> None:
        self.rows, self.flat, self.start = {}, np.zeros(0, np.int32), np.zeros(1, np.int64)

    def learn(self, new: list[str]) -> None:
        """Adds the ids of pieces: rows ``start[k]`` to ``start[k + 1]`` of ``flat``."""
        groups: dict[int, list[tuple[str, bytes]]] = {}
        for piece in new:
            b = piece.encode()
            size = 0 if b in self.ranks else 2 << max(len(b) - 2, 1).bit_length() - 1
            groups.setdefault(size if size <= WIDEST else -1, []).append((piece, b))
        for size, members in groups.items():
            names, pieces = zip(*members)
            if size > 0:
                flat, count = encode_alike(list(pieces), self.pairs, size)
            else:
                each = [[self.ranks[b]] if size == 0 else encode_piece(b, self.ranks) for b in pieces]
                flat, count = np.array(list(chain.from_iterable(each)), np.int32), np.fromiter(map(len, each), np.int64, len(each))
            self.rows.update(zip(names, range(len(self.rows), len(self.rows) + len(names))))
            self.flat = np.concatenate([self.flat, flat])
            self.start = np.concatenate([self.start, self.start[-1] + count.cumsum()])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out, chunk, held = [], [], 0
        for text in texts:
            chunk.append(self.cut(text) if text else [])
            held += len(text or "")
            if held >= CHUNK_CHARS:
                out += self._ids(chunk)
                chunk, held = [], 0
        return out + self._ids(chunk)

    def _ids(self, chunk: list[list[str]]) -> list[np.ndarray]:
        if len(self.rows) > HELD_PIECES:
            self.forget()
        if new := set(chain.from_iterable(chunk)).difference(self.rows):
            self.learn(list(new))
        total = sum(map(len, chunk))
        row = np.fromiter(map(self.rows.__getitem__, chain.from_iterable(chunk)), np.int64, total)
        count = self.start[row + 1] - self.start[row]
        ends = count.cumsum()
        ids = self.flat[np.arange(ends[-1] if total else 0) + np.repeat(self.start[row] - ends + count, count)]
        cuts = np.append(0, ends)[np.cumsum([0, *map(len, chunk)])].tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]


def encode(docs: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids of ``text``; a null or empty text has none.

    Rows are independent: repeated rows and ids, null ids and further columns
    stay as they are; a column named ``ids`` is replaced. An empty table gives
    an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def make():
        encoder = Encoder(shared.value, pattern)
        return lambda texts: [encoder.encode(texts)]

    return add_columns(docs, make, {ids: "array<int>"}, binary=False)


def decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the bytes their token ids stand for; null ids give empty bytes, an unknown id stops the job.

    The result is binary: ids cut in the middle of a character needn't be valid UTF-8.
    """
    shared = rows.sparkSession.sparkContext.broadcast({rank: token for token, rank in read_ranks(path).items()})
    kept = [c for c in rows.columns if c != out]
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))
    place = kept.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = shared.value.__getitem__
        for batch in batches:
            row = batch.column("row")
            lists = row.field(place)
            ends = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).cumsum().tolist()
            flat = lists.flatten().to_numpy().tolist()
            texts = [b"".join(map(token, flat[a:b])) for a, b in zip([0, *ends], ends)]
            yield pa.RecordBatch.from_arrays([row, pa.array(texts, pa.binary())], ["row", out])

    mapped = arrow_map(packed, run, with_fields(packed, {out: "binary"}))
    return mapped.select(*[F.col(f"row.`{c}`") for c in kept], out)
