"""Main text of web pages by a recurrent block labeller.

A page is read into blocks, the runs of text between block-level tags, each
with the tags and class words it lies under. Every block becomes a vector: the
mean of learned vectors of its hashed path, the mean of those of its hashed
words, and a few shares. A bidirectional LSTM reads the blocks of the whole
page, and each is kept or not from its own vector and both directions.

The labeller is trained on a bounded sample of pages. Their labels follow from
the sections they mark (article and main, without what lies under navigation,
notices and the like); blocks of invented notices, forms, comments and sidebars
are mixed in, so that kinds the sample lacks are known too.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, pick

# Parameters: sampled pages, hashed paths and words, sizes of vectors and state, rounds, batch and rate of the fit.
PAGES = 300
PATHS, WORDS = 2048, 2048
VECTOR, STATE = 12, 12
ROUNDS, BATCH, RATE = 14, 50, 0.02
EXTRA = 5  # path vector, word vector and these shares
LONGEST_FIT = 200  # blocks of a page used at once in the fit
PAGES_AT_ONCE = 64

# Tags that don't end a block, tags without an end, tags whose text is never shown.
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template noscript iframe object svg select option textarea button head title".split())
# Tags and class words of what is not the article, and of what is.
OUTSIDE = frozenset(
    "nav header footer aside form menu dialog ad ads advert adverts advertisement sponsor sponsored banner promo cookie cookies consent gdpr notice "
    "alert popup modal newsletter subscribe sidebar widget navbar navigation breadcrumb breadcrumbs comment comments respond reply share social related "
    "pagination toolbar login signup".split()
)
INSIDE = frozenset("article main".split())
SPACE = re.compile(r"[\x20\x09-\x0D]+")
CLASS_WORD = re.compile(r"[a-z]+")


class Blocks(HTMLParser):
    """Blocks of a page as (path, text, letters inside links); wrong nesting is closed as browsers do, roughly."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, tuple[str, ...]]] = []
        self.blocks: list[tuple[tuple[str, ...], str, int]] = []
        self.text: list[str] = []
        self.linked = self.hidden = self.links = 0

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.text)).strip(" ")
        if text:
            self.blocks.append((tuple(k for _, keys in self.open for k in keys), text, self.linked))
        self.text, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in INLINE:
            self.links += tag == "a"
            return
        self.flush() if tag != "br" else self.text.append(" ")
        if tag in VOID:
            return
        if tag in ("p", "li", "option", "tr", "td", "th", "dt", "dd"):
            self._close(tag, stop=("ul", "ol", "table", "dl", "div", "article", "section"))
        said = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v).lower()
        self.open.append((tag, (tag, *[f".{w}" for w in CLASS_WORD.findall(said)])))
        self.hidden += tag in HIDDEN

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in INLINE:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in INLINE:
            self.links = max(0, self.links - (tag == "a"))
            return
        if tag == "br":
            self.text.append(" ")
            return
        self.flush()
        self._close(tag)
        if tag in ("nav", "article", "section", "div", "ul", "footer", "body"):
            self.links = 0

    def _close(self, tag: str, stop: tuple[str, ...] = ()) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            name = self.open[i][0]
            if name == tag:
                self.hidden -= sum(n in HIDDEN for n, _ in self.open[i:])
                del self.open[i:]
                return
            if name in stop:
                return

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.text.append(data)
            if self.links:
                self.linked += len(data)


def blocks_of(html: str | None) -> list[tuple[tuple[str, ...], str, int]]:
    parser = Blocks()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.blocks


def marked(path: tuple[str, ...]) -> bool:
    """Whether the sections of a page mark a block as the article's."""
    names = {p.lstrip(".") for p in path}
    return bool(names & INSIDE) and not names & OUTSIDE


def keys_of(block: tuple[tuple[str, ...], str, int]) -> tuple[list[int], list[int], list[float]]:
    """Hashed path, hashed distinct words, and shares of a block."""
    path, text, linked = block
    words = text.lower().split(" ")
    shares = [min(len(text) / 200, 2.0), min(len(words) / 30, 2.0), min(linked / len(text), 1.0), min(20 * sum(text.count(c) for c in ".,;!?") / len(text), 2.0), 1.0]
    return [crc32(p.encode()) % PATHS for p in path] or [0], sorted({crc32(w.encode()) % WORDS for w in words}), shares


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Labeller:
    """Parameters by name: vectors of paths and words, two LSTMs and the output."""

    p: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, seed: int = 3) -> "Labeller":
        r = np.random.default_rng(seed)
        size = 2 * VECTOR + EXTRA
        p = {"path": r.normal(0, 0.3, (PATHS, VECTOR)), "word": r.normal(0, 0.1, (WORDS, VECTOR)), "out": r.normal(0, 0.1, (2 * STATE + size,)), "bias": np.zeros(1)}
        for d in "fb":
            p[f"x{d}"], p[f"h{d}"] = r.normal(0, 0.2, (size, 4 * STATE)), r.normal(0, 0.2, (STATE, 4 * STATE))
        return cls(p)

    def vectors(self, pages: list[list[tuple]]) -> tuple[np.ndarray, np.ndarray, tuple]:
        """(page, block, vector) with a mask, and what the fit needs to send slopes back to the tables."""
        n, longest = len(pages), max(map(len, pages))
        flat = [k for page in pages for k in page]
        at = np.concatenate([i * longest + np.arange(len(page)) for i, page in enumerate(pages)]).astype(np.int64)
        x, mask = np.zeros((n * longest, 2 * VECTOR + EXTRA)), np.zeros(n * longest)
        mask[at], back = 1, []
        for k, name in enumerate(("path", "word")):
            sizes = np.array([len(b[k]) for b in flat], np.int64)
            owner, index = np.repeat(at, sizes), np.concatenate([b[k] for b in flat]).astype(np.int64)
            share = np.repeat(1 / sizes, sizes)
            np.add.at(x[:, k * VECTOR : (k + 1) * VECTOR], owner, self.p[name][index] * share[:, None])
            back.append((name, owner, index, share))
        x[at, 2 * VECTOR :] = np.array([b[2] for b in flat])
        return x.reshape(n, longest, -1), mask.reshape(n, longest), tuple(back)

    def _pass(self, x: np.ndarray, mask: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        n, longest, _ = x.shape
        order = range(longest) if d == "f" else range(longest - 1, -1, -1)
        h, c = np.zeros((n, STATE)), np.zeros((n, STATE))
        out, kept = np.zeros((n, longest, STATE)), []
        from_x = x @ self.p[f"x{d}"]
        for t in order:
            gates = from_x[:, t] + h @ self.p[f"h{d}"]
            i, f, o = (_logistic(gates[:, k * STATE : (k + 1) * STATE] + (k == 1)) for k in range(3))
            g, m = np.tanh(gates[:, 3 * STATE :]), mask[:, t, None]
            c_new = f * c + i * g
            kept.append((t, h, c, i, f, o, g, np.tanh(c_new), m))
            h, c = m * (o * kept[-1][7]) + (1 - m) * h, m * c_new + (1 - m) * c
            out[:, t] = h
        return out, kept

    def chances(self, pages: list[list[tuple]]) -> tuple[np.ndarray, np.ndarray]:
        """Chance of every block to be the article's, with the mask."""
        x, mask, _ = self.vectors(pages)
        seen = np.concatenate([self._pass(x, mask, "f")[0], self._pass(x, mask, "b")[0], x], axis=2)
        return _logistic(seen @ self.p["out"] + self.p["bias"]), mask

    def slopes(self, pages: list[list[tuple]], gold: list[list[int]]) -> dict[str, np.ndarray]:
        """Slopes of the mean log loss by every parameter."""
        x, mask, back = self.vectors(pages)
        wanted = np.zeros(mask.shape)
        for i, row in enumerate(gold):
            wanted[i, : len(row)] = row
        runs = {d: self._pass(x, mask, d) for d in "fb"}
        seen = np.concatenate([runs["f"][0], runs["b"][0], x], axis=2)
        error = (_logistic(seen @ self.p["out"] + self.p["bias"]) - wanted) * mask / mask.sum()
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["out"], g["bias"] = np.einsum("nt,ntk->k", error, seen), np.array([error.sum()])
        to_seen = error[..., None] * self.p["out"]
        to_x = to_seen[..., 2 * STATE :].copy()
        for k, d in enumerate("fb"):
            to_out, dh, dc = to_seen[..., k * STATE : (k + 1) * STATE], np.zeros((len(x), STATE)), np.zeros((len(x), STATE))
            for t, h, c, i, f, o, gg, tc, m in reversed(runs[d][1]):
                dh = dh + to_out[:, t]
                own = dh * m
                through = dc * m + own * o * (1 - tc * tc)
                gates = np.concatenate([through * gg * i * (1 - i), through * c * f * (1 - f), own * tc * o * (1 - o), through * i * (1 - gg * gg)], axis=1)
                g[f"x{d}"] += x[:, t].T @ gates
                g[f"h{d}"] += h.T @ gates
                to_x[:, t] += gates @ self.p[f"x{d}"].T
                dh, dc = gates @ self.p[f"h{d}"].T + dh * (1 - m), through * f + dc * (1 - m)
        flat = to_x.reshape(-1, to_x.shape[2])
        for k, (name, owner, index, share) in enumerate(back):
            np.add.at(g[name], index, flat[owner, k * VECTOR : (k + 1) * VECTOR] * share[:, None])
        return g


def with_extras(blocks: list[tuple], draw: np.random.Generator) -> tuple[list[tuple], list[int]]:
    """A sampled page with invented blocks mixed in, as blocks and labels.

    Notices, forms, comments and sidebars hold words of the page itself, so that
    their place and path tell them, not their words. At times the article's
    container is another of those that mark one.
    """
    words = " ".join(t for _, t, _ in blocks).split(" ")
    out = [(b, int(marked(b[0]))) for b in blocks]
    if draw.random() < 0.3:
        out = [((tuple("main" if p == "article" else p for p in b[0]), *b[1:]), y) for b, y in out]
    kinds = sorted(OUTSIDE)
    for _ in range(int(draw.integers(0, 5))):
        kind = kinds[draw.integers(len(kinds))]
        name = kind if kind in ("nav", "header", "footer", "aside", "form") else None
        path = ("html", "body", *(("article",) if draw.random() < 0.4 else ()), *((name,) if name else ("div", f".{kind}")), *(("p",) if draw.random() < 0.5 else ()))
        at = int(draw.integers(len(words)))
        text = " ".join(words[at : at + int(draw.integers(1, 30))]) or kind
        place = int(draw.integers(len(out) + 1))
        run = [((path, text, 0), 0)] * int(draw.integers(1, 3))
        out[place:place] = run
    return [b for b, _ in out], [y for _, y in out]


def fit(pages: list[list[tuple]], rounds: int = ROUNDS, seed: int = 3) -> Labeller:
    """Adam over the sampled pages' blocks; long pages are cut into parts for the fit only."""
    model, draw = Labeller.fresh(seed), np.random.default_rng(seed)
    rows = []
    for blocks in pages:
        made, gold = with_extras(blocks, draw)
        keys = [keys_of(b) for b in made]
        rows += [(keys[a : a + LONGEST_FIT], gold[a : a + LONGEST_FIT]) for a in range(0, len(keys), LONGEST_FIT)]
    first, second, step = {k: 0.0 for k in model.p}, {k: 0.0 for k in model.p}, 0
    for _ in range(rounds):
        order = draw.permutation(len(rows))
        for a in range(0, len(rows), BATCH):
            batch = [rows[i] for i in order[a : a + BATCH]]
            step += 1
            for k, g in model.slopes([b for b, _ in batch], [y for _, y in batch]).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                model.p[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return model


def train(pages: DataFrame, most: int = PAGES) -> Labeller:
    """Fit on at most ``most`` whole pages, first by a hash of page_id."""
    order = F.md5(F.concat(F.lit("pages:"), F.col("page_id").cast("string")))
    sample = pick(pages, "page_id", "html").where("page_id is not null and html is not null").orderBy(order, "page_id").limit(most)
    return fit([b for b in (blocks_of(r["html"]) for r in sorted(sample.collect(), key=lambda r: r["page_id"])) if b])


def extract(pages: DataFrame, model: Labeller) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages(page_id, url, html)``.

    Kept blocks in page order, joined by one blank. Null and empty pages and
    pages without a kept block have an empty text. Null ids and repeated rows
    are read like others, an empty table gives an empty result.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model.p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Labeller(shared.value)
        for batch in batches:
            blocks = [blocks_of(h) for h in batch.column("html").to_pylist()]
            texts = [""] * len(blocks)
            order = sorted((i for i in range(len(blocks)) if blocks[i]), key=lambda i: len(blocks[i]))
            for a in range(0, len(order), PAGES_AT_ONCE):
                part = order[a : a + PAGES_AT_ONCE]
                chance, _ = own.chances([[keys_of(b) for b in blocks[i]] for i in part])
                for i, row in zip(part, chance):
                    texts[i] = " ".join(b[1] for b, c in zip(blocks[i], row) if c > 0.5)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return arrow_map(pick(pages, "page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")


def extract_pages(pages: DataFrame) -> DataFrame:
    """Train on a sample of ``pages`` and extract all of them."""
    return extract(pages, train(pages))
