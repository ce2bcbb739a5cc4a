"""Language-model scores by online logistic context mixing.

A text is a sequence of words and one end. Each is coded in bits: a frequent
word by its Huffman code, any other by an escape code and then its letters,
byte by byte, or by its share of the other words' counts, whose chances are mixed in
proportion to how many of these counts are repetitions. Three bit predictors with ever longer contexts (no context, the
word before, the two words before; for spelling the one, two and three bytes
before) hold counts for each context of its own, without hashing. Their predictions, as
logits, are added with weights; a gate, how much the longer contexts have seen,
chooses the weights. The weights are learned over all training texts, go on
learning inside each scored text, block by block, and the mix is refined by an
adaptive map from (gate, prediction) to observed frequency.

All counts are taken over all training texts. What tasks share is the code of
``HEAD`` words, the counts of its nodes, the letter contexts seen, the weights
and the map. The counts of word contexts are a table that grows with the input:
texts in chunks ask for the (context, symbol) pairs they hold, packed in blocks
by bucket of contexts; a bucket adds the counts up along the code and answers
each block in its order, a node that several pairs pass once. What spells a word
is worked out once for each run of four bytes. Words beyond the head meet their
counts by a join.
"""

from __future__ import annotations

import heapq
import pickle
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from .. import session
from ..session import materialise
from .common import arrow_map, pick, utf8
from .language_id import held_out
from .texts import with_fields

# Parameters: most words with codes of their own and their least count, bits of a symbol in a context, words
# of a chunk of texts, pairs of a bucket of contexts, bits between updates of the weights, counts turned to logits at
# once, the rate of the weights, and words and runs of four bytes held before a flush.
HEAD = 1 << 17
LEAST_HEAD = 5
SYMBOL_BITS = 18
CHUNK = 1_000_000
BUCKET = 1_000_000
BLOCK = 4096
LEANT = 1 << 14
RATE = 0.3
FLUSH = 400_000
GRAMS = 1_000_000
GATES, STEPS_OF_MAP, REACH = 16, 33, 12.0
START = (0.6, 0.3, 0.3)
SIGNS = np.array([-1, 1], np.float32)
PACK = pa.Codec("zstd", 3)
DROP_SHUFFLED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ODD = np.uint64(0x9E3779B97F4A7C15)


@contextmanager
def _dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """What jobs in here have shuffled leaves the disk when they end."""
    before = spark.conf.get(DROP_SHUFFLED, "false")
    spark.conf.set(DROP_SHUFFLED, "true")
    try:
        yield
    finally:
        spark.conf.set(DROP_SHUFFLED, before)


@dataclass
class Code:
    """Huffman code: symbols 0.. are the head's words, then escape and end; nodes are numbered from 0."""

    numbers: dict
    offset: np.ndarray
    length: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray

    def __post_init__(self):
        if self.length.max() > 64:
            raise ValueError("a code of more than 64 bits")
        step = np.arange(len(self.bits)) - np.repeat(self.offset, self.length)
        paths = np.bitwise_or.reduceat(self.bits.astype(np.uint64) << (63 - step).astype(np.uint64), self.offset)
        self.symbol = np.argsort(paths)
        self.path = paths[self.symbol]  # of each leaf, its first bit on top
        self.leaf = np.empty(len(paths), np.int64)
        self.leaf[self.symbol] = np.arange(len(paths))

    def __getstate__(self):  # each executor keeps a file of what tasks share
        raw = pickle.dumps(self.__dict__, 5)
        return len(raw), PACK.compress(raw, asbytes=True)

    def __setstate__(self, state):
        self.__dict__.update(pickle.loads(PACK.decompress(state[1], state[0])))

    @property
    def escape(self) -> int:
        return len(self.numbers)


def huffman(words: list[bytes], counts: list[int], escapes: int, ends: int) -> Code:
    """Code of the words, the escape and the end by their counts (one at least); ties by order."""
    weights = [*counts, max(escapes, 1), max(ends, 1)]
    heap = [(w, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    total = len(weights)
    parent, side = np.zeros(2 * total - 1, np.int64), np.zeros(2 * total - 1, np.uint8)
    for node in range(total, 2 * total - 1):
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        parent[x] = parent[y] = node
        side[y] = 1
        heapq.heappush(heap, (a + b, node))
    root, offset, nodes, bits = 2 * total - 2, [], [], []
    for symbol in range(total):
        offset.append(len(nodes))
        path, at = [], symbol
        while at != root:
            path.append((int(parent[at]) - total, int(side[at])))
            at = int(parent[at])
        nodes += [n for n, _ in reversed(path)]
        bits += [b for _, b in reversed(path)]
    offset = np.array(offset, np.int64)
    length = np.diff(np.append(offset, len(nodes)))
    return Code({w: i for i, w in enumerate(words)}, offset, length, np.array(nodes, np.int32), np.array(bits, np.uint8))


def word_bits(code: Code, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and bits of a text's symbols, its end included."""
    length = code.length[symbols]
    ends = np.cumsum(length)
    at = np.repeat(code.offset[symbols] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)
    return code.nodes[at], code.bits[at]


def distinct(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct ``keys``, numbers below 2^bits, and the place of each key among them.

    A key and where it stands are sorted as one number where both fit, which is
    several times as fast as sorting the places; else runs in order are merged.
    """
    shift = len(keys).bit_length()
    if bits + shift <= 63:
        found = np.sort(keys << shift | np.arange(len(keys)))
        at = found & ((1 << shift) - 1)
        found >>= shift
    else:
        at = np.argsort(keys, kind="stable")
        found = keys[at]
    fresh = np.diff(found, prepend=-1) != 0
    places = np.empty(len(keys), np.int64)
    places[at] = np.cumsum(fresh) - 1
    return found[fresh], places


def word_pairs(code: Code, symbols: np.ndarray, lengths: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (context, symbol) pairs of texts laid end to end, by bucket of the context; the bucket of each; and (predictor, symbol) places in them.

    A pair is a number of its own: the predictor, the two words before or the
    one, and the leaf. Contexts don't reach over a text's end.
    """
    first = np.cumsum(lengths) - lengths
    step = np.arange(len(symbols)) - np.repeat(first, lengths)
    shifted = np.concatenate((np.zeros(2, np.int64), symbols + 1))[: len(symbols) + 1]
    one = np.where(step > 0, shifted[1:], 0)
    two = np.where(step > 1, shifted[:-1], 0)
    near, near_at = distinct((one << SYMBOL_BITS) | code.leaf[symbols], 2 * SYMBOL_BITS)
    # the word before and the leaf are known by their place, which keeps their order
    width = len(near).bit_length()
    far, far_at = distinct((two << width) | near_at, SYMBOL_BITS + width)
    far = (2 << 3 * SYMBOL_BITS) | ((far >> width) << 2 * SYMBOL_BITS) | near[far & ((1 << width) - 1)]
    pairs, places = np.concatenate(((1 << 3 * SYMBOL_BITS) | near, far)), np.concatenate((near_at, far_at + len(near)))
    bucket = ((((pairs >> SYMBOL_BITS).astype(np.uint64) * ODD) >> np.uint64(33)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
    order = np.argsort(bucket, kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return pairs[order], bucket[order], rank[places].reshape(2, -1)


def shared_levels(code: Code, pairs: np.ndarray) -> np.ndarray:
    """The deepest level at which each pair's path is that of the pair before, -1 where the contexts differ; and a last -1."""
    path, context = code.path[pairs & ((1 << SYMBOL_BITS) - 1)], pairs >> SYMBOL_BITS
    apart = path[1:] ^ path[:-1]
    high = apart >> np.uint64(32)
    top = np.frexp(np.where(high > 0, high, apart).astype(np.float64))[1]  # at most 32 bits, so the float is exact
    out = np.full(len(pairs) + 1, -1, np.int8)
    out[1:-1] = np.where(context[1:] == context[:-1], np.where(high > 0, 32, 64) - top, -1)[: max(len(pairs) - 1, 0)]
    return out


def path_counts(code: Code, pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often the context of each of sorted distinct ``pairs`` was at the root, each node of the path and the leaf.

    Flat, each path up to its last change, and the lengths kept. Leaves are
    numbered from left to right, so all below a node are neighbours; a path is
    followed until no other pair is below its node.
    """
    shared = shared_levels(code, pairs)
    alone = np.maximum(shared[:-1], shared[1:]) + 1
    rows, levels = np.arange(len(pairs), dtype=np.int32), []
    now, last = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    for j in range(int(alone.max(initial=-1)) + 1):
        rows = rows[alone[rows] >= j]
        fresh = shared[rows] < j
        value = np.add.reduceat(counts[rows], np.flatnonzero(fresh))[np.cumsum(fresh) - 1]
        if j:
            last[rows[value != now[rows]]] = j
        now[rows] = value
        levels.append((rows, value))
    kept = last + 1
    start = np.cumsum(kept) - kept
    flat = np.empty(int(kept.sum()), np.int64)
    for j, (rows, value) in enumerate(levels):
        long = kept[rows] > j
        flat[start[rows[long]] + j] = value[long]
    return flat, kept


def node_rows(shared: np.ndarray, kept: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each level the pairs that keep it, and which of them is the first of its node."""
    rows, shared = np.arange(len(kept)), shared[:-1]
    for j in range(int(kept.max(initial=0))):
        long = np.flatnonzero(kept[rows] > j)
        # a path shares with the last one left what all between them share
        shared = np.minimum.reduceat(shared[: long[-1] + 1], np.append(0, long[:-1] + 1))
        rows = rows[long]
        yield j, rows, shared < j


def planes(numbers: np.ndarray, width: int) -> bytes:
    """Numbers of ``width`` bytes, byte by byte (all first bytes, then all second ones), compressed."""
    raw = np.ascontiguousarray(numbers.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    return PACK.compress(raw.tobytes(), asbytes=True)


def unplaned(data: bytes, width: int, size: int) -> np.ndarray:
    raw = np.frombuffer(PACK.decompress(data, size * width), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(raw.T).view(f"<u{width}").ravel().astype(np.int64)


def packed_counts(values: np.ndarray, kept: np.ndarray, shared: np.ndarray) -> bytes:
    """One byte for each length and for each root's count and each node's fall from the one above, level by level, four more from 255 on."""
    start = np.cumsum(kept) - kept
    places = ((start[rows[fresh]] + j, j > 0) for j, rows, fresh in node_rows(shared, kept))
    values = np.concatenate([values[at - 1] - values[at] if inner else values[at] for at, inner in places])
    raw = kept.astype(np.uint8).tobytes() + np.minimum(values, 255).astype(np.uint8).tobytes() + values[values >= 255].astype("<u4").tobytes()
    return len(raw).to_bytes(4, "little") + PACK.compress(raw, asbytes=True)


def unpacked_counts(data: bytes, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data, pairs = PACK.decompress(data[4:], int.from_bytes(data[:4], "little")).to_pybytes(), len(shared) - 1
    kept = np.frombuffer(data, np.uint8, pairs).astype(np.int64)
    levels = list(node_rows(shared, kept))
    nodes = sum(int(fresh.sum()) for _, _, fresh in levels)
    found = np.frombuffer(data, np.uint8, nodes, pairs).astype(np.int64)
    found[found == 255] = np.frombuffer(data, "<u4", -1, pairs + nodes) if len(data) > pairs + nodes else 0
    values, start, at = np.empty(int(kept.sum()), np.int64), np.cumsum(kept) - kept, 0
    for j, rows, fresh in levels:
        place = np.cumsum(fresh)
        value = found[at - 1 + place]
        values[start[rows] + j] = values[start[rows] + j - 1] - value if j else value
        at += int(place[-1])
    return values, kept


def letter_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each byte of the words and of a closing blank behind the three bytes before, in one number; and the first of each word."""
    flat = np.frombuffer(b"".join(b"\0\0 " + w + b" " for w in words), np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    first = np.cumsum(sizes) - sizes
    at = np.arange(int(sizes.sum())) + np.repeat(3 * np.arange(1, len(words) + 1), sizes)
    return flat[at - 3] << 24 | flat[at - 2] << 16 | flat[at - 1] << 8 | flat[at], first


def gram_bits(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts with nodes, and bits, of the last byte of each gram, high bits first."""
    eight, own = np.arange(8), grams.astype(np.int64)[:, None]
    node = ((own & 255) | 256) >> (8 - eight)  # 1, then the bits so far behind a 1
    bits = ((own >> (7 - eight)) & 1).astype(np.uint8).ravel()
    # each context is a number of its own: how many bytes, the bytes, the node
    keys = np.stack([(((k + 1) << 32) | (own & ((1 << 8 * (k + 2)) - 256)) | node).ravel() for k in range(3)])
    return keys, bits


def spelled_bits(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts with nodes, bits and the first bit of each word, for its bytes and a closing blank, high bits first."""
    grams, first = letter_grams(words)
    return *gram_bits(grams), 8 * first


@dataclass
class Mixer:
    """Counts of ones and zeros by slot, weights by (gate, predictor), the refining map by (gate, step)."""

    zeros: np.ndarray
    ones: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.tile(START, (GATES, 1)))
    refined: np.ndarray | None = None
    keys: np.ndarray | None = None

    def __post_init__(self):
        self.logit, self.level = _evidence(self.zeros, self.ones)

    def run(self, slots: np.ndarray, bits: np.ndarray, weights: np.ndarray, rate: float, own: np.ndarray | None = None, seen: np.ndarray | None = None) -> np.ndarray:
        """Bits of information in each bit. ``weights`` learn after every block but the last; ``seen`` gathers the map's counts instead, and they learn after all.

        ``own`` is how often each bit was itself counted: learning leaves that
        out, or the longest contexts would seem to know everything.
        """
        if own is None:
            logit, level = self.logit[slots], self.level[slots]
        else:
            ones_of = own * bits
            logit, level = _evidence(self.zeros[slots] - (own - ones_of), self.ones[slots] - ones_of)
        return self.mix(logit, level, bits, weights, rate, seen)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Places of contexts among ``keys``; those never counted share the last place, which is empty."""
        at = np.searchsorted(self.keys, keys)
        known = np.append(self.keys, -1)[at] == keys
        return np.where(known, at, len(self.keys))

    def mix(self, evidence: np.ndarray, levels: np.ndarray, bits: np.ndarray, weights: np.ndarray, rate: float, seen: np.ndarray | None = None) -> np.ndarray:
        """The same from the (predictor, bit) logits and levels."""
        out = np.empty(len(bits), np.float32)
        half, scale, one = np.float32(0.5), np.float32((STEPS_OF_MAP - 1) / (2 * REACH)), np.float32(1)
        gates = (levels[-2] * np.uint8(4) + levels[-1]).astype(np.intp)
        for a in range(0, len(bits), BLOCK):
            logit, gate, bit = evidence[:, a : a + BLOCK], gates[a : a + BLOCK], bits[a : a + BLOCK].astype(np.float32)
            own = np.ascontiguousarray(weights.T, np.float32)
            mixed = own[0].take(gate)
            mixed *= logit[0]
            for k in range(1, len(logit)):
                part = own[k].take(gate)
                part *= logit[k]
                mixed += part
            np.minimum(mixed, np.float32(REACH), out=mixed)
            np.maximum(mixed, np.float32(-REACH), out=mixed)
            p = np.exp(-mixed)
            p += one
            np.divide(one, p, out=p)
            if seen is not None or self.refined is not None:
                mixed += np.float32(REACH)
                mixed *= scale
                mixed += half
                step = mixed.astype(np.intp)
                step += gate * STEPS_OF_MAP
            if seen is None:
                final = p if self.refined is None else half * (p + self.refined.take(step))
                out[a : a + BLOCK] = np.log(np.abs(final + (bit - one))) * np.float32(-1 / np.log(2))  # of a zero, one less the chance
            if rate and (seen is not None or a + BLOCK < len(bits)):  # nothing is scored by what a text's last block teaches
                error, count = bit - p, np.bincount(gate, minlength=GATES) + 256
                for k in range(len(logit)):
                    weights[:, k] += rate * np.bincount(gate, error * logit[k], GATES) / count
            if seen is not None:
                seen += np.bincount(step * 2 + bits[a : a + BLOCK], minlength=seen.size).reshape(seen.shape)
        return out


def _evidence(zeros: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logit of a one and level of confidence (0 to 3) from counts."""
    known = zeros + ones
    level = (known > 0).astype(np.uint8) + (known >= 4) + (known >= 32)
    return np.log((ones + np.float32(0.4)) / (zeros + np.float32(0.4))), level


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) over all ``docs(text)``, words lower-cased."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: Counter = Counter()

        def flush() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(counted.keys(), pa.binary()).cast(pa.string()), pa.array(counted.values(), pa.int64())], ["word", "n"])
            counted.clear()
            return rows

        for batch in batches:
            for text in utf8(batch, "text"):
                counted.update((text or b"").lower().split())
            if len(counted) > FLUSH:
                yield flush()
        yield flush()

    return arrow_map(pick(docs, "text"), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def head_count(vocab: DataFrame, most: int = HEAD) -> int:
    """Least count of a word with a code of its own, so that at most ``most`` words have one.

    From a histogram over sixteenths of powers of two: a few hundred rows.
    """
    bins = vocab.groupBy(F.ceil(F.log2("n") * 16).alias("bin")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect()
    total, least = 0, 1 << 62
    for row in sorted(bins, reverse=True):
        total += row["words"]
        if total > most or row["least"] < LEAST_HEAD:
            break
        least = row["least"]
    return least


def _letter_counts(tail: DataFrame) -> Mixer:
    """Counts of each letter context in ``tail(word, n)``: rows reach the driver for distinct runs of up to four bytes only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            found, at = np.unique(np.concatenate([g for g, _ in held]), return_inverse=True)
            total = np.bincount(at, np.concatenate([n for _, n in held]), len(found)).astype(np.int64)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(total)], ["gram", "n"])

        for batch in batches:
            grams, first = letter_grams(utf8(batch, "word"))
            held.append((grams, np.repeat(batch.column("n").to_numpy(), np.diff(np.append(first, len(grams))))))
            size += len(grams)
            if size > GRAMS:
                yield flush()
                size = 0
        if held:
            yield flush()

    got = arrow_map(tail, run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    grams, n = got.column("gram").to_numpy(), got.column("n").to_numpy()
    parts = []
    for k in range(3):
        own, at = np.unique(grams & ((1 << 8 * (k + 2)) - 1), return_inverse=True)
        keys, bits = gram_bits(own)
        keys, place = np.unique(keys[k], return_inverse=True)
        weight = np.repeat(np.bincount(at, n, len(own)), 8)
        parts.append((keys, np.bincount(place * 2 + bits, weight, 2 * len(keys)).reshape(-1, 2)))
    totals = np.concatenate([t for _, t in parts] + [np.zeros((1, 2))]).astype(np.float32)
    return Mixer(totals[:, 0], totals[:, 1], keys=np.concatenate([k for k, _ in parts]))


class Spelling:
    """Contexts' places, and bits that spelling takes, found once for each run of four bytes; emptied when full."""

    def __init__(self, letters: Mixer):
        self.letters = letters
        self.clear()

    def clear(self) -> None:
        self.grams, self.slots, self.spent = np.zeros(0, np.int64), np.zeros((0, 3, 8), np.int32), np.zeros(0)

    def rows(self, grams: np.ndarray) -> np.ndarray:
        """Rows of ``slots`` and ``spent`` for distinct grams, until the next call."""
        if len(self.grams) > GRAMS:
            self.clear()
        new = np.setdiff1d(grams, self.grams)
        if len(new):
            keys, bits = gram_bits(new)
            slots = self.letters.slots(keys)
            spent = self.letters.run(slots, bits, self.letters.weights, 0.0).reshape(-1, 8).sum(axis=1, dtype=np.float64)
            order = np.argsort(np.concatenate((self.grams, new)))
            slots = slots.reshape(3, -1, 8).swapaxes(0, 1).astype(np.int32)
            self.grams, self.slots, self.spent = (np.concatenate(x)[order] for x in ((self.grams, new), (self.slots, slots), (self.spent, spent)))
        return np.searchsorted(self.grams, grams)

    def bits(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        grams, first = letter_grams(words)
        found, at = np.unique(grams, return_inverse=True)
        rows = self.rows(found.astype(np.int64))
        return np.add.reduceat(self.spent[rows][at], first)


def _asked(chunks: DataFrame, code, buckets: int) -> DataFrame:
    """(chunk, bucket, pairs, counts): what the texts of each chunk ask of each bucket, and how often its training texts hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, _, held, symbols, lengths, _ in _chunks(batch):
                pairs, bucket, places = word_pairs(code.value, symbols, lengths, buckets)
                counted = np.tile(np.repeat(~held, lengths), 2)
                counts = np.bincount(places.ravel(), counted, len(pairs)).astype("<u4")
                cuts = np.flatnonzero(np.diff(bucket.astype(np.int64), prepend=-1))
                ends = np.append(cuts[1:], len(pairs))
                blocks = [(planes(np.diff(pairs[a:b], prepend=0), 8), planes(counts[a:b], 4)) for a, b in zip(cuts.tolist(), ends.tolist())]
                columns = [pa.array(np.full(len(cuts), chunk)), pa.array(bucket[cuts].astype(np.int64)), pa.array([p for p, _ in blocks], pa.binary()), pa.array([c for _, c in blocks], pa.binary()), pa.array(ends - cuts)]
                yield pa.RecordBatch.from_arrays(columns, ["chunk", "bucket", "pairs", "counts", "size"])

    return arrow_map(chunks, run, "chunk long, bucket long, pairs binary, counts binary, size long")


def _answered(asked: DataFrame, code) -> DataFrame:
    """(chunk, bucket, data): the counts along the paths of the pairs asked, in their order."""

    def run(table: pa.Table) -> pa.Table:
        sizes = table.column("size").to_pylist()
        blocks = [np.cumsum(unplaned(p.as_py(), 8, n)) for p, n in zip(table.column("pairs"), sizes)]
        counts = np.concatenate([unplaned(c.as_py(), 4, n) for c, n in zip(table.column("counts"), sizes)]).astype(np.float64)
        pairs, at = distinct(np.concatenate(blocks), 3 * SYMBOL_BITS + 2)
        values, kept = path_counts(code.value, pairs, np.bincount(at, counts, len(pairs)).astype(np.int64))
        start, end, data = np.cumsum(kept) - kept, 0, []
        for block in blocks:
            mine, end = at[end : end + len(block)], end + len(block)
            size = kept[mine]
            ends = np.cumsum(size)
            data.append(packed_counts(values[np.repeat(start[mine] - (ends - size), size) + np.arange(ends[-1])], size, shared_levels(code.value, block)))
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "data": pa.array(data, pa.binary())})

    return asked.groupBy("bucket").applyInArrow(run, "chunk long, bucket long, data binary")


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Chunk, rows, held out, symbols laid end to end, their numbers by text, and the answers by bucket, if there are any.

    The symbols are packed beside the texts, or lie in them as lists.
    """
    for i in range(batch.num_rows):
        texts = batch.column("texts").slice(i, 1).flatten()
        if "packed" in batch.schema.names:
            lengths = texts.field("n_tokens").to_numpy()
            symbols = unplaned(batch.column("packed")[i].as_py(), 4, int(lengths.sum()))
        else:
            lengths = np.diff(texts.field("symbols").offsets.to_numpy()).astype(np.int64)
            symbols = texts.field("symbols").flatten().to_numpy().astype(np.int64)
        held = texts.field("held_out").to_numpy(zero_copy_only=False).astype(bool)
        blocks = None
        if "blocks" in batch.schema.names:
            found = batch.column("blocks").slice(i, 1).flatten()
            order = np.argsort(found.field("bucket").to_numpy())
            data = found.field("data")
            blocks = [data[int(k)].as_py() for k in order]
        yield batch.column("chunk")[i].as_py(), texts.field("row").to_numpy(), held, symbols, lengths, blocks


def _texts(batch: pa.RecordBatch, code: Code, mixer: Mixer, buckets: int, learning: bool) -> Iterator[tuple]:
    """Row, logits, levels and bits of each text, or of each training text with its own counts left out."""
    own = int(learning)
    below = np.where(code.bits, mixer.ones[code.nodes], mixer.zeros[code.nodes])
    plain = _leaning(mixer.zeros[code.nodes] + mixer.ones[code.nodes], below, own)[0]
    for _, rows, held, symbols, lengths, blocks in _chunks(batch):
        pairs, bucket, places = word_pairs(code, symbols, lengths, buckets)
        cuts = np.append(np.flatnonzero(np.diff(bucket.astype(np.int64), prepend=-1)), len(pairs))
        got = [unpacked_counts(d, shared_levels(code, pairs[a:b])) for d, a, b in zip(blocks, cuts[:-1].tolist(), cuts[1:].tolist())]
        del pairs, bucket
        values, kept = (np.concatenate(x) for x in zip(*got))
        del got
        ends = np.cumsum(kept)
        below = np.append(values[1:], 0)
        below[ends - 1] = values[ends - 1]
        # the level in the last two bits of the logit, the length of a path beside its start: one look-up each
        lean = np.empty(len(values), np.uint32)
        for a in range(0, len(values), LEANT):
            logit, level = _leaning(values[a : a + LEANT].astype(np.float32), below[a : a + LEANT].astype(np.float32), own)
            lean[a : a + LEANT] = (logit.view(np.uint32) & np.uint32(0xFFFFFFFC)) | level
        paths, end = (ends - kept) << 8 | (kept - 1), np.cumsum(lengths)
        del values, kept, ends, below
        for row, out, a, b in zip(rows.tolist(), held.tolist(), (end - lengths).tolist(), end.tolist()):
            if not (learning and out):
                yield row, *_text_evidence(code, plain, symbols[a:b], places[:, a:b], lean, paths)


def _leaning(known: np.ndarray, below: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
    """Logit of the bit that is next on a path, and level, from the counts of its node and of the next one, less ``own``."""
    taken = np.maximum(below - np.float32(own), np.float32(0))
    known = known - np.float32(own)
    level = (known > 0).astype(np.uint8) + (known >= 4) + (known >= 32)
    return np.log((taken + np.float32(0.4)) / (known + np.float32(own) - below + np.float32(0.4))), level


def _text_evidence(code: Code, plain: np.ndarray, symbols: np.ndarray, places: np.ndarray, lean: np.ndarray, paths: np.ndarray) -> tuple:
    length = code.length[symbols]
    ends = np.cumsum(length)
    at = np.arange(ends[-1])
    step = at - np.repeat(ends - length, length)
    at = step + np.repeat(code.offset[symbols], length)
    bits = code.bits.take(at)
    logit, levels = np.empty((3, len(bits)), np.float32), np.empty((2, len(bits)), np.uint8)
    plain.take(at, out=logit[0], mode="clip")
    for k, place in enumerate(places):
        path = paths.take(place)
        start = path >> 8
        found = np.repeat(start, length)
        found += step
        np.minimum(found, np.repeat(start + (path & 255), length), out=found)
        both = lean.take(found)
        logit[k + 1] = both.view(np.float32)
        np.bitwise_and(both, np.uint32(3), out=levels[k], casting="unsafe")
    logit *= SIGNS.take(bits)
    return logit, levels, bits


def _learning(batches: Iterator[pa.RecordBatch], mixer: Mixer, pieces: Callable) -> Iterator[pa.RecordBatch]:
    """A task's weights times its bits, its bits, and its counts for the map, as (place, value)."""
    weights, seen, total = mixer.weights.copy(), np.zeros((GATES * STEPS_OF_MAP, 2), np.int64), 0
    for batch in batches:
        for logit, level, bits in pieces(batch):
            mixer.mix(logit, level, bits, weights, RATE, seen)
            total += len(bits)
    values = np.concatenate([weights.ravel() * total, [total], seen.ravel()])
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values, pa.float64())], ["place", "value"])


def _learned(mixer: Mixer, rows: DataFrame) -> Mixer:
    """Average of the tasks' weights by their bits, and the map of all tasks' counts."""
    got = {r["place"]: r["value"] for r in rows.groupBy("place").agg(F.sum("value").alias("value")).collect()}
    size = mixer.weights.size
    total = got.get(size, 0.0)
    if total:
        values = np.array([got[i] for i in range(len(got))])
        mixer.weights = (values[:size] / total).reshape(mixer.weights.shape)
        seen = values[size + 1 :].reshape(-1, 2)
        own = 1 / (1 + np.exp(-np.tile(np.linspace(-REACH, REACH, STEPS_OF_MAP), GATES)))
        mixer.refined = ((seen[:, 1] + 16 * own) / (seen.sum(axis=1) + 16)).astype(np.float32)
    return mixer


def _spelled_pieces(batch: pa.RecordBatch, spelling: Spelling) -> Iterator[tuple]:
    mixer = spelling.letters
    grams, first = letter_grams(utf8(batch, "word"))
    own = np.repeat(batch.column("n").to_numpy(), np.diff(np.append(first, len(grams))))
    found, at = np.unique(own << 32 | grams, return_inverse=True)  # the same run in words as frequent tells the same
    grams, own = found & 0xFFFFFFFF, (found >> 32).astype(np.float32)[:, None, None]
    rows = spelling.rows(grams)
    slots, bits = spelling.slots[rows], gram_bits(grams)[1].reshape(-1, 1, 8)
    ones_of = own * bits
    logit, level = _evidence(mixer.zeros[slots] - (own - ones_of), mixer.ones[slots] - ones_of)
    yield *(np.ascontiguousarray(x.swapaxes(0, 1)).take(at, axis=1).reshape(3, -1) for x in (logit, level)), bits.reshape(-1, 8)[at].ravel()


@dataclass
class Model:
    """Totals for the base score, and the code with the two mixers; that of words has still to learn."""

    code: Code
    counts: np.ndarray
    tokens: int
    distinct: int
    words: Mixer
    letters: Mixer
    tail_tokens: int
    tail_again: float


def train(docs: DataFrame, vocab: DataFrame, head: int = HEAD) -> tuple[Model, int]:
    """The model over ``docs(text)`` with their stored ``vocab(word, n)``, and the least count of a head word."""
    spark = docs.sparkSession
    docs = pick(docs, "text")
    texts = docs.count()
    words, distinct = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least = head_count(vocab, head)
    rows = vocab.where(F.col("n") >= least).orderBy(F.desc("n"), "word").toArrow()  # at most ``head`` rows
    heads, counts = rows.column("word").cast(pa.binary()).to_pylist(), rows.column("n").to_numpy()
    code = huffman(heads, counts.tolist(), words - int(counts.sum()), texts)
    tail = vocab.where(F.col("n") < least)
    # without context a node is passed as often as the symbols below it are counted
    passed = np.repeat([*counts.tolist(), int(words - counts.sum()), texts], code.length)
    word_mixer = Mixer(*(np.bincount(code.nodes, passed * (code.bits == side)).astype(np.float32) for side in (0, 1)))
    letter_mixer = _letter_counts(tail)
    letters = spark.sparkContext.broadcast(letter_mixer)

    def learn_letters(batches):
        spelling = Spelling(letters.value)
        return _learning(batches, letters.value, lambda batch: _spelled_pieces(batch, spelling))

    _learned(letter_mixer, arrow_map(tail, learn_letters, "place long, value double"))
    known = np.concatenate([counts, [0], [texts]]).astype(np.int64)
    tail_tokens = int(words - counts.sum())
    once = tail.where("n = 1").count()
    again = max(tail_tokens - once, 0) / max(tail_tokens, 1)
    return Model(code, known, int(words) + texts, int(distinct) + bool(texts), word_mixer, letter_mixer, tail_tokens, again), least


def coded(docs: DataFrame, model: Model) -> DataFrame:
    """(chunk, size, texts, packed, tail) of ``docs(doc_id, text, held_out)``: chunks of texts, their symbols and the words beyond the head.

    ``tail.bits`` is what spelling a word takes. Rows and chunks are numbered
    as they are read, so the result is to be stored before it is used.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = with_fields(docs.select("doc_id"), {"row": "long", "held_out": "boolean", "n_tokens": "long", "n_head": "long", "base_head": "double", "n_bytes": "long"})
    tail = with_fields(docs.select(), {"row": "long", "word": "string", "times": "int", "bits": "double"})
    schema = ST.StructType().add("chunk", "long").add("size", "long").add("texts", ST.ArrayType(text)).add("packed", "binary").add("tail", ST.ArrayType(tail))

    def listed(arrays: list, names: list[str]) -> pa.Array:
        rows = pa.StructArray.from_arrays(arrays, names)
        return pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        code, numbers, spelling = own.code, own.code.numbers, Spelling(own.letters)
        base = np.log10((own.counts + 1) / (own.tokens + own.distinct + 1))
        base[code.escape] = 0.0  # those words meet their counts later
        known = own.counts > 0
        chunk = row = TaskContext.get().partitionId() << 40
        ids, texts, symbols, tails = [], [], [], []

        def flush() -> pa.RecordBatch:
            nonlocal chunk
            row, out, sizes, *rest = (pa.array(x) for x in zip(*texts))
            flat = np.concatenate(symbols)
            columns = [pa.array([chunk]), pa.array([len(flat)]), listed([pa.concat_arrays(ids), row, out, sizes, *rest], text.names), pa.array([planes(flat, 4)], pa.binary())]
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.float64())
            columns.append(listed([pa.array(x, k) for x, k in zip(zip(*tails) if tails else [[]] * 4, kinds)], tail.names))
            chunk += 1
            for x in (ids, texts, symbols, tails):
                x.clear()
            return pa.RecordBatch.from_arrays(columns, schema.names)

        for batch in batches:
            split = [(t or b"").lower().split() for t in utf8(batch, "text")]
            coded = [np.fromiter(map(numbers.get, w, repeat(code.escape)), np.int32, len(w)) for w in split]
            beyond = [Counter(w[i] for i in np.flatnonzero(s == code.escape).tolist()) for w, s in zip(split, coded)]
            unknown = sorted(set().union(*beyond))
            spelled = dict(zip(unknown, spelling.bits(unknown).tolist()))
            done, size = 0, sum(map(len, symbols))
            outs, n_bytes = batch.column("held_out").to_pylist(), [len(t or b"") for t in utf8(batch, "text")]
            for i, (s, rare) in enumerate(zip(coded, beyond)):
                s = np.append(s, np.int32(code.escape + 1))
                if size and size + len(s) > CHUNK:
                    ids.append(batch.column("doc_id").slice(done, i - done))
                    yield flush()
                    done, size = i, 0
                row, size = row + 1, size + len(s)
                texts.append((row, outs[i], len(s), int(known[s].sum()), float(base[s].sum()), n_bytes[i]))
                symbols.append(s)
                tails.extend((row, w.decode(), n, spelled[w]) for w, n in sorted(rare.items()))
            ids.append(batch.column("doc_id").slice(done))
        if texts:
            yield flush()

    return arrow_map(docs, run, schema)


def head_bits(chunks: DataFrame, model: Model) -> DataFrame:
    """The texts of ``coded`` chunks with head_bits: all but the spelling of the words beyond the head.

    Counts and learning are over those not held out; ``model.words`` learns here.
    """
    spark = chunks.sparkSession
    total = chunks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    buckets = max(1, -(-2 * total // BUCKET))
    code = spark.sparkContext.broadcast(model.code)
    chunks = chunks.select("chunk", "texts", "packed")
    answers = _answered(_asked(chunks, code, buckets), code)
    with _dropping_shuffles(spark):
        answers = materialise(answers, "lm-met", "zstd")
    met = chunks.join(answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "data")).alias("blocks")), "chunk")
    words = spark.sparkContext.broadcast(model.words)

    def learn(batches):
        own, mixer = code.value, words.value
        return _learning(batches, mixer, lambda batch: (x[1:] for x in _texts(batch, own, mixer, buckets, True)))

    with _dropping_shuffles(spark):
        _learned(model.words, arrow_map(met, learn, "place long, value double"))
    learned = spark.sparkContext.broadcast(model.words)

    def spend(batches):
        own, mixer = code.value, learned.value
        for batch in batches:
            spent = [float(mixer.mix(logit, level, bits, mixer.weights.copy(), RATE).sum(dtype=np.float64)) for _, logit, level, bits in _texts(batch, own, mixer, buckets, False)]
            texts = batch.column("texts").flatten()
            yield pa.RecordBatch.from_arrays([*texts.flatten(), pa.array(spent, pa.float64())], [*texts.type.names, "head_bits"])

    text = chunks.schema["texts"].dataType.elementType
    scored = arrow_map(met, spend, ST.StructType([*text.fields, ST.StructField("head_bits", ST.DoubleType())]))
    with _dropping_shuffles(spark):
        return session.materialise(scored, "lm-scored", "zstd")


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for every row.

    Learned from the rows that are not held out, applied to all. Null texts are
    empty: one end. With nothing to learn from, base counts are zero and all
    words are spelled. Null ids and repeated rows are scored like others; an
    empty table gives an empty result. ``docs`` needs doc_id and text, further
    columns are ignored.
    """
    docs = pick(docs, "doc_id", "text").withColumn("held_out", held_out(F.col("doc_id"), 7))
    training = docs.where("not held_out")
    with _dropping_shuffles(docs.sparkSession):
        vocab = materialise(vocabulary(training), "lm-vocabulary", "zstd")
    model, least = train(training, vocab)
    chunks = materialise(coded(docs, model), "lm-chunks", "zstd")
    scored = head_bits(chunks, model)
    pairs = chunks.select(F.explode("tail").alias("t")).select("t.row", "t.word", "t.times", "t.bits")
    met = pairs.join(vocab.where(F.col("n") < least), "word", "left").withColumn("c", F.coalesce("n", F.lit(0)))
    logged = F.log10((F.col("c") + 1) / F.lit(float(model.tokens + model.distinct + 1)))
    listed = F.lit(model.tail_again / max(model.tail_tokens, 1)) * F.col("c")
    # spelling a long word may be less likely than a double can say: without a count its bits are taken as they are
    spelled = F.lit(1 - model.tail_again) * F.pow(F.lit(2.0), -F.col("bits"))
    spent = F.when(listed > 0, -F.log2(listed + spelled)).otherwise(F.col("bits") - F.lit(float(np.log2(max(1 - model.tail_again, 1e-9)))))
    rest = met.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times"))).alias("known"), F.sum(F.col("times") * logged).alias("base"), F.sum(F.col("times") * spent).alias("bits")
    )
    bits = F.col("head_bits") + F.coalesce("bits", F.lit(0.0))
    return scored.join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_head") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base_head") + F.coalesce("base", F.lit(0.0))).alias("base_score"),
        (-bits * F.lit(float(np.log10(2)))).alias("score"),
        F.when(F.col("n_bytes") > 0, bits / F.col("n_bytes")).alias("bits_per_byte"),
    )
