"""Language ID, secrets, ratings, scores and extraction: brute force, round trips and held-out accuracy."""

import itertools
import math
import os
import pickle
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fewlabel.llm import html_extract, language_id, lm_score, quality_classifier, secret_scan

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language_viterbi_equals_enumeration():
    r = np.random.default_rng(1)
    lengths = np.array([3, 0, 5, 1])
    scores = r.normal(size=(9, 3)).astype(np.float32)
    path, end = language_id.decode(scores, lengths, 1.0), 0
    for n in lengths:
        part, end = scores[end : end + n], end + n
        if n:
            best = max(itertools.product(range(3), repeat=int(n)), key=lambda p: sum(part[t, s] for t, s in enumerate(p)) - sum(a != b for a, b in zip(p, p[1:])))
            assert tuple(path[end - n : end]) == best


def test_scripts_narrow_the_candidates():
    names = ["en", "ru"]
    candidates = np.zeros((len(language_id.SCRIPT_NAMES), 2), bool)
    candidates[0, 0] = candidates[2, 1] = True
    model = language_id.Languages(names, np.zeros((1 << 4, 2), np.float32), candidates, 4)
    latin, cyrillic, digits = model.words(["word", "слово", "123"])
    assert latin[:2].argmax() == 0 and cyrillic[:2].argmax() == 1 and digits.tolist() == [0, 0, 0]
    # one long word of another script amid words of the first is a span of its own
    rows = model.words(["plain", "words", "словослово", "and", "more"])
    assert language_id.decode(rows[:, :2].astype(np.float32), np.array([5])).tolist() == [0, 0, 1, 0, 0]


def test_language_of_held_out_texts_and_spans(spark, docs):
    got = language_id.predict(docs).collect()
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    out = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in out) >= 0.97 * len(out) and all(0 <= r["score"] <= 1 for r in got)
    text = {r["lang"]: r["text"] for r in docs.where("length(text) between 400 and 900").collect()}
    mixed = spark.createDataFrame([(1, text["en"] + " " + text["de"])], "doc_id long, text string")
    spans = language_id.label(mixed, language_id.train(docs), spans=True).first()["lang_spans"].split(",")
    assert [s.split(":")[0] for s in spans] == ["en", "de"]
    assert abs(int(spans[0].split(":")[2]) - len(text["en"].split())) < 12


def slow_base(text):
    """The contract's patterns, scanned in one pass each without shortcuts."""
    found = []
    for m in re.finditer(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    for k, pattern, least in ((1, "AKIA[A-Z0-9]+", 20), (2, "[0-9a-f]+", 24)):
        found += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return sorted(found)


def test_base_spans_equal_brute_force(docs):
    texts = [r["text"] for r in docs.collect()]
    texts += ["PassWord='abcdef1'", "api_key:  short", "apikey=\"x.y-z_9=\"", "token = token = abcdefg", "AKIA" + "A" * 15, "xAKIA" + "B" * 16, "é" * 3 + "f" * 24, "f" * 23, "ſecret=abcdef", "password==abcdef"]
    for t in texts:
        assert secret_scan.base_spans(t) == slow_base(t)


def test_field_decoding_equals_enumeration_and_shortcut():
    r = np.random.default_rng(2)
    for _ in range(20):
        scores, transition = r.normal(size=(5, 3)), r.normal(size=(3, 3))
        best = max(itertools.product(range(3), repeat=5), key=lambda p: sum(scores[t, s] for t, s in enumerate(p)) + sum(transition[a, b] for a, b in zip(p, p[1:])))
        assert tuple(secret_scan.viterbi(scores, transition)) == best
        field = secret_scan.Field(np.zeros((1, 3)), transition)
        scores[:, 0] += 3
        sure = scores[:, 0] - scores[:, 1:].max(axis=1) > field.slack()
        assert not secret_scan.viterbi(scores, transition)[sure].any()


def test_field_learns_and_adds(spark):
    key = "Zq9{}Lm2Xx7{}Tt5"
    rows = [(i, f"some words here then password={key.format(i, i * 7)} and more words follow now") for i in range(200)]
    rows += [(1000 + i, "plain words only and nothing else to see in this text today") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    field = secret_scan.train(docs)
    new = spark.createDataFrame([(1, f"some words here then passphrase={key.format(5, 9)} and more words follow now"), (2, rows[-1][1])], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in secret_scan.scan(new, field).collect()}
    assert got == {1: "crf:21:46", 2: ""}


def test_field_sees_into_long_words(spark):
    """The secret's own stretch of a long unspaced word is found, wherever it stands, also beside a base span."""
    key = "Zq9{}Lm2Xx7{}Tt5"
    rows = [(i, f"some words here then password={key.format(i, i * 7)} and more words follow now") for i in range(200)]
    rows += [(1000 + i, f"see https://www.example.org/view/{i}?id={i}&page=overview&sort=name for more words") for i in range(200)]
    rows += [(2000 + i, '{"id":%d,"list":[%d,2,3],"name":"plain words","after":%d}' % (i, i, i)) for i in range(200)]
    rows += [(3000 + i, '{"id":%d,"password":"%s","name":"plain words"}' % (i, key.format(i * 3, i))) for i in range(200)]
    field = secret_scan.train(spark.createDataFrame(rows, "doc_id long, text string"))
    secret = key.format(5, 9)
    long = {
        1: f"https://host.example.com/path/a/b?api=1&passphrase={secret}&page=overview",
        2: "https://host.example.com/path/a/b?api=1&passphrase=overview&page=overview",
        3: '{"a":1,"list":[1,2,3],"name":"plain words","passphrase":"' + secret + '","after":2}',
        4: f"some words here then password={secret}&passphrase={secret} and more",
    }
    new = spark.createDataFrame(list(long.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"].split(",") if r["spans"] else [] for r in secret_scan.scan(new, field).collect()}

    def shown(i):
        return [long[i][int(a) : int(b)] for kind, a, b in (x.split(":") for x in got[i]) if kind == "crf"]

    assert shown(2) == []
    assert len(shown(1)) == 1 and shown(1)[0].endswith(secret) and "page" not in shown(1)[0] and "host" not in shown(1)[0]
    assert len(shown(3)) == 1 and shown(3)[0].endswith(secret) and "plain" not in shown(3)[0]
    assert got[4][0] == f"assign:21:{30 + len(secret)}" and shown(4) in ([f"passphrase={secret}"], [secret])


def test_forms_see_whole_tokens():
    plain, late = "ab" * 600, "ab" * 600 + "9X7"
    assert secret_scan.describe(plain) != secret_scan.describe(late)
    assert "".join(secret_scan.TOKENS.findall("a=b&c=/d//e \t\"x\"")) == "a=b&c=/d//e\"x\""
    tags = np.array([1, 2, 2, 2, 0])
    text = "token=abcdef&sig=Zq9xT7 end"
    assert secret_scan.field_spans(text, tags, secret_scan.base_spans(text)) == [(13, 3, 23)]


def test_ratings_on_held_out_labels(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    half = labels.where("doc_id % 2 = 0")
    model = quality_classifier.train(docs, half)
    assert (np.diff(model.thresholds) > 0).all()
    rated = quality_classifier.rate(docs, model).join(quality_classifier.grades(labels.where("doc_id % 2 = 1")), "doc_id").collect()
    good = [r["kept"] for r in rated if r["grade"] == 2]
    bad = [r["kept"] for r in rated if r["grade"] < 2]
    assert np.mean(good) > 0.93 and np.mean(bad) < 0.4
    below = model.below(np.array([-1.0, 0.0, 2.0]))
    assert (np.diff(below, axis=1) >= 0).all() and (np.diff(below, axis=0) <= 0).all()


def test_ordinal_fit_recovers_the_order():
    r = np.random.default_rng(4)
    grade = r.integers(0, 3, 600)
    features = [np.array(sorted({int(g), *map(int, r.integers(10, 40, 5))})) for g in grade]
    model = quality_classifier.fit(features, grade, np.ones(600), bits=6)
    assert model.weights[0] < model.weights[1] < model.weights[2]
    score = np.array([model.weights[f].sum() for f in features])
    assert ((1 - model.below(score)).sum(axis=1).round() == grade).mean() > 0.97


def test_code_and_spelling_round_trip():
    words = [b"the", b"of", b"and", b"x"]
    code = lm_score.huffman(words, [50, 30, 10, 5], 3, 7)
    symbols = np.array([0, 3, 4, 1, 2, 0, 5])
    slots, bits = lm_score.word_bits(code, symbols)
    paths = {tuple(code.bits[o : o + n]): s for s, (o, n) in enumerate(zip(code.offset, code.length))}
    back, held = [], ()
    for b in bits.tolist():
        held += (b,)
        if held in paths:
            back.append(paths[held])
            held = ()
    assert back == symbols.tolist() and not held
    assert sum(2.0 ** -len(p) for p in paths) == 1  # every bit sequence has a meaning, so chances sum to one
    _, spelled, first = lm_score.spelled_bits([b"ab", "é".encode(), b""])
    assert np.packbits(spelled).tobytes() == b"ab " + "é".encode() + b" " + b" " and first.tolist() == [0, 24, 48]


def test_chances_of_the_next_bit_sum_to_one():
    r = np.random.default_rng(0)
    mixer = lm_score.Mixer(r.integers(0, 9, 64).astype(np.float32), r.integers(0, 9, 64).astype(np.float32))
    slots = r.integers(0, 64, (3, 100))
    zero, one = (mixer.run(slots, np.full(100, b, np.uint8), mixer.weights.copy(), 0.0) for b in (0, 1))
    assert np.allclose(2.0**-zero + 2.0**-one, 1, atol=1e-5)


@pytest.mark.parametrize("bits", [12, 60])
def test_distinct_numbers_with_and_without_their_places_in_one(bits):
    r = np.random.default_rng(21)
    for keys in (r.integers(0, 1 << 12, 5000), np.zeros(0, np.int64), np.array([3]), np.array([(1 << bits) - 1, 0, (1 << bits) - 1])):
        found, places = lm_score.distinct(keys, bits)
        want, at = np.unique(keys, return_inverse=True)
        assert np.array_equal(found, want) and np.array_equal(places, at)


def test_nothing_is_learned_from_the_last_block_of_a_scored_text():
    r = np.random.default_rng(22)
    mixer = lm_score.Mixer(r.integers(0, 9, 64).astype(np.float32), r.integers(0, 9, 64).astype(np.float32))
    slots, bits = r.integers(0, 64, (3, lm_score.BLOCK + 100)), r.integers(0, 2, lm_score.BLOCK + 100).astype(np.uint8)
    one, two = mixer.weights.copy(), mixer.weights.copy()
    short = mixer.run(slots[:, : lm_score.BLOCK], bits[: lm_score.BLOCK], one, lm_score.RATE)
    long = mixer.run(slots, bits, two, lm_score.RATE)
    assert np.array_equal(one, mixer.weights) and not np.array_equal(two, mixer.weights)
    assert np.array_equal(short, long[: lm_score.BLOCK])
    seen = np.zeros((lm_score.GATES * lm_score.STEPS_OF_MAP, 2), np.int64)
    mixer.run(slots[:, : lm_score.BLOCK], bits[: lm_score.BLOCK], one, lm_score.RATE, seen=seen)
    assert not np.array_equal(one, mixer.weights) and seen.sum() == lm_score.BLOCK


def test_word_contexts_are_counted_one_by_one(spark):
    r = np.random.default_rng(3)
    code = lm_score.huffman([b"w%d" % i for i in range(30)], [int(x) for x in r.integers(1, 90, 30)], 4, 9)
    rows = [(i, i // 4, i % 5 == 0, [*r.integers(0, 31, r.integers(0, 60)).tolist(), 31]) for i in range(40)]
    rows += [(40, 10, False, [3, 4] * 400 + [31])]  # counts of more than a byte
    seen = Counter()
    for _, _, held, symbols in rows:
        for t, x in enumerate(symbols):
            for j in range(0 if held else code.length[x]):
                node, bit = code.nodes[code.offset[x] + j], code.bits[code.offset[x] + j]
                seen.update({(k, *symbols[max(t - k, 0) : t], t < k, node, bit): 1 for k in (1, 2)})
    texts = spark.createDataFrame(rows, "row long, chunk long, held_out boolean, symbols array<int>")
    chunks = texts.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("row", "held_out", "symbols"))).alias("texts"))
    shared = spark.sparkContext.broadcast(code)
    answers = lm_score._answered(lm_score._asked(chunks, shared, 7), shared).groupBy("chunk").agg(F.collect_list(F.struct("bucket", "data")).alias("blocks"))
    mixer = lm_score.Mixer(*np.ones((2, len(code.length)), np.float32))
    got = {}
    for batch in chunks.join(answers, "chunk").toArrow().to_batches():
        got |= {row: (logit, bits) for row, logit, _, bits in lm_score._texts(batch, code, mixer, 7, False)}
    assert len(got) == len(rows)
    for row, _, _, symbols in rows:
        want = []
        for t, x in enumerate(symbols):
            for j in range(code.length[x]):
                node, bit = code.nodes[code.offset[x] + j], code.bits[code.offset[x] + j]
                zero, one = ([seen[(k, *symbols[max(t - k, 0) : t], t < k, node, b)] for k in (1, 2)] for b in (0, 1))
                want.append([math.log((o + 0.4) / (z + 0.4)) for z, o in zip(zero, one)])
        assert np.allclose(got[row][0][1:].T, want, atol=1e-5)


def test_letter_contexts_never_share_counts():
    r = np.random.default_rng(4)
    words = [bytes(r.integers(97, 123, 12).astype(np.uint8)) for _ in range(20_000)]
    keys, bits, _ = lm_score.spelled_bits(words)
    want = {(w[max(t - 3, 0) : t], 1 << j | (b" "[0] if t == len(w) else w[t]) >> 8 - j) for w in words for t in range(len(w) + 1) for j in range(8)}
    assert len(want) > 1 << 18 and len(np.unique(keys[2])) >= len({(c, n) for c, n in want if len(c) == 3})


def test_a_node_that_pairs_share_is_sent_once():
    r = np.random.default_rng(5)
    code = lm_score.huffman([b"w%d" % i for i in range(500)], [int(x) for x in r.integers(1, 3000, 500)], 4, 9)
    pairs = np.unique(r.integers(1, 4, 900) << 54 | r.integers(0, 3, 900) << 18 | r.integers(0, 502, 900))
    counts = r.integers(0, 2, len(pairs)) * r.integers(0, 2000, len(pairs))
    values, kept = lm_score.path_counts(code, pairs, counts)
    shared = lm_score.shared_levels(code, pairs)
    data = lm_score.packed_counts(values, kept, shared)
    back = lm_score.unpacked_counts(data, shared)
    assert (back[0] == values).all() and (back[1] == kept).all()
    assert sum(int(fresh.sum()) for _, _, fresh in lm_score.node_rows(shared, kept)) < len(values) / 3
    ends, context, leaf = np.cumsum(kept), pairs >> 18, pairs & (1 << 18) - 1
    for i in r.integers(0, len(pairs), 60).tolist():
        own, full = values[ends[i] - kept[i] : ends[i]].tolist(), []
        n = code.length[code.symbol[leaf[i]]]
        for j in range(n + 1):
            below = [k for k in np.flatnonzero(context == context[i]) if j == 0 or int(code.path[leaf[k]] ^ code.path[leaf[i]]) >> (64 - j) == 0]
            full.append(int(counts[below].sum()))
        assert own + [own[-1]] * (n + 1 - len(own)) == full


def test_spelling_by_runs_equals_spelling_by_words():
    r = np.random.default_rng(6)
    words = [bytes(r.integers(97, 101, r.integers(0, 9)).astype(np.uint8)) for _ in range(300)] + ["é".encode() * 3]
    keys, bits, first = lm_score.spelled_bits(words)
    mixer = lm_score.Mixer(*r.integers(0, 9, (2, 400)).astype(np.float32), keys=np.unique(keys)[:399])
    want = np.add.reduceat(mixer.run(mixer.slots(keys), bits, mixer.weights, 0.0).astype(float), first)
    spelling = lm_score.Spelling(mixer)
    assert np.allclose(np.concatenate([spelling.bits(words[:90]), spelling.bits(words[90:])]), want, rtol=1e-6) and not len(spelling.bits([]))


def test_what_the_language_model_keeps_on_disk(docs, monkeypatch):
    stored = []
    for where in (lm_score, lm_score.session):
        monkeypatch.setattr(where, "materialise", lambda *args, keep=where.materialise: stored.append(keep(*args)) or stored[-1])
    assert lm_score.score_documents(docs).count() == docs.count()
    kept = sum(os.path.getsize(f.removeprefix("file://")) for s in stored for f in s.inputFiles())
    assert kept < 2.2 * os.path.getsize(f"{SF}/documents.parquet")  # 2.9 times the input when texts were stored again with their answers
    assert docs.sparkSession.conf.get(lm_score.DROP_SHUFFLED) == "false"
    code = lm_score.huffman([b"w%d" % i for i in range(20_000)], list(range(30_000, 10_000, -1)), 4, 9)
    assert len(pickle.dumps(code)) < 2 * len(code.nodes) and pickle.loads(pickle.dumps(code)).path.tolist() == code.path.tolist()


def test_base_scores_equal_brute_force(docs):
    def tokens(text):
        return [*re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")), None]

    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    counts = Counter(t for i, x in rows.items() if zlib.crc32(str(i).encode()) % 7 != 2 for t in tokens(x))
    total, distinct = sum(counts.values()), len(counts)
    got = lm_score.score_documents(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        own = tokens(rows[r["doc_id"]])
        want = sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in own)
        assert r["base_score"] == pytest.approx(want, rel=1e-9) and r["n_known"] == sum(counts[t] > 0 for t in own)
        assert r["n_tokens"] == len(own) and r["train_tokens"] == total and r["score"] < 0
    assert sum(r["score"] for r in got if not r["held_out"]) > sum(r["base_score"] for r in got if not r["held_out"])


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script><style>p{}</style></head><body>
<nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav><div class="cookie-notice">We use cookies</div><!-- c -->
<article><h1>Big &amp; small</h1><p>First <b>bo</b>ld,<br>line   two.<p>Second &#233;l.</article>
<aside class="sidebar"><p>Other stories</p></aside><div id="comments"><p>Nice post!</p></div>
<form><p>Your mail</p></form><footer>&copy; us</footer></body></html>"""


def test_extraction_of_known_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    model = html_extract.train(pages)
    own = spark.createDataFrame([(1, "u", PAGE)], "page_id long, url string, html string")
    assert html_extract.extract(own, model).first()["text"] == "Big & small First bold, line two. Second él."
    rows = {r["page_id"]: r["html"] for r in pages.collect()}
    wrong = 0
    for r in html_extract.extract(pages, model).collect():
        inside = re.search("<article>(.*)</article>", rows[r["page_id"]], re.S)[1]
        plain = re.sub("<b>|</b>", "", inside)
        import html

        want = " ".join(html.unescape(re.sub("<[^>]*>", " ", plain)).split())
        wrong += r["text"] != want
    assert wrong == 0


def test_labeller_slopes_equal_differences():
    model = html_extract.Labeller.fresh()
    pages = [[html_extract.keys_of((("article", "p"), f"words {i} here", 0)) for i in range(4)], [html_extract.keys_of((("nav",), "menu", 4))]]
    gold = [[1, 0, 1, 1], [0]]

    def loss():
        chance, mask = model.chances(pages)
        wanted = np.zeros_like(mask)
        wanted[0, :4], wanted[1, :1] = gold
        return -(mask * (wanted * np.log(chance) + (1 - wanted) * np.log(1 - chance))).sum() / mask.sum()

    slopes = model.slopes(pages, gold)
    for name in model.p:
        at = np.unravel_index(np.abs(slopes[name]).argmax(), slopes[name].shape)
        old = model.p[name][at]
        model.p[name][at] = old + 1e-5
        up = loss()
        model.p[name][at] = old - 1e-5
        down = loss()
        model.p[name][at] = old
        assert slopes[name][at] == pytest.approx((up - down) / 2e-5, rel=1e-4)


def test_language_model_tables_are_stored_compactly(spark, monkeypatch):
    import pyarrow.parquet as pq

    from fewlabel.llm import lm_score

    stored = []
    monkeypatch.setattr(lm_score, "materialise", lambda *args, keep=lm_score.materialise: stored.append(keep(*args)) or stored[-1])
    docs = spark.createDataFrame([(i, f"plum bark {i % 3} the the oak") for i in range(30)], "doc_id long, text string")
    assert lm_score.score_documents(docs).count() == 30
    codecs = {pq.ParquetFile(f.removeprefix("file://")).metadata.row_group(0).column(0).compression for s in stored for f in s.inputFiles()}
    assert len(stored) == 3 and codecs == {"ZSTD"}
