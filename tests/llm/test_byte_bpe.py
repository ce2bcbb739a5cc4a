"""Byte-level BPE against an independent encoder and exact round trips."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from fewlabel.llm import byte_bpe
from fewlabel.llm.queries import QUERIES

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def encoder(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def merged_slowly(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if rank == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def test_piece_equals_repeated_scans(ranks):
    pick = random.Random(5)
    for n in [1, 2, 3, 4, 5, 8, 9, 16, 17, 60]:
        for _ in range(30):
            piece = bytes(pick.choice(b"aabeinth \xc3\xa9\xff") for _ in range(n))
            assert byte_bpe.encode_piece(piece, ranks) == ([ranks[piece]] if piece in ranks else merged_slowly(piece, ranks))


def test_side_by_side_equals_one_by_one(ranks):
    pick = random.Random(8)
    encoder = byte_bpe.Encoder(ranks, PATTERN)
    pieces = ["".join(pick.choice("aabeinth é漢") for _ in range(pick.randint(1, 70))) for _ in range(900)]
    encoder.learn(sorted(set(pieces)))
    for p in pieces:
        k = encoder.rows[p]
        assert encoder.flat[encoder.start[k] : encoder.start[k + 1]].tolist() == byte_bpe.encode_piece(p.encode(), ranks)


def test_forgets_when_full(ranks, encoder, monkeypatch):
    monkeypatch.setattr(byte_bpe, "HELD_PIECES", 5)
    monkeypatch.setattr(byte_bpe, "CHUNK_CHARS", 20)
    texts = [f"word{i} another{i % 3} text" for i in range(40)] + [None, ""]
    got = byte_bpe.Encoder(ranks, PATTERN).encode(texts)
    assert [g.tolist() for g in got] == [encoder.encode_ordinary(t or "") for t in texts]


def test_ties_go_left():
    ranks = {b"a": 0, b"b": 1, b"aa": 2, b"aaaa": 3}
    assert byte_bpe.encode_piece(b"aaa", ranks) == [2, 0]
    assert byte_bpe.encode_piece(b"aaaaa", ranks) == [3, 0]
    with pytest.raises(ValueError, match="no token"):
        byte_bpe.encode_piece(b"ac", ranks)


def test_long_piece(ranks, encoder):
    pick = random.Random(6)
    text = "".join(pick.choice("abcdeinth") for _ in range(60_000))
    assert byte_bpe.encode_piece(text.encode(), ranks) == encoder.encode_ordinary(text)


TEXTS = [None, "", " ", "\n\n  \t x", "It's 1234's  end ", "日本語のテキスト 漢字", "naïve café 😀👩‍👩‍👧", "<|endoftext|> plain", "x" * 3000, "tie tie tie"]


def test_whole_table(spark, encoder):
    rows = [(i, t, "other", 7) for i, t in enumerate(TEXTS)] + [(None, "no id", "other", 7), (9, "tie tie tie", "other", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string, ids int")
    got = byte_bpe.decode(byte_bpe.encode(docs, PATH, PATTERN), PATH).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["ids"] == encoder.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    null = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [bytes(r["decoded"]) for r in byte_bpe.decode(null, PATH).collect()] == [b"", b""]
    assert byte_bpe.decode(byte_bpe.encode(docs.limit(0), PATH, PATTERN), PATH).count() == 0


def test_query(spark, encoder):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op13_byte_bpe"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = encoder.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
