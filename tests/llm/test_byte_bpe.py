"""Operator 2 against the library whose results it must give."""

import hashlib
import pickle
import random

import public_tokenizers as public
import pytest
import tiktoken

from lodestack.llm import byte_bpe


@pytest.fixture(scope="module")
def pair():
    bpe = byte_bpe.public_bpe()
    return bpe, tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def test_perfect_hash_is_minimal(pair):
    bpe, _ = pair
    at = bpe.hash.slots(bpe.entries)
    assert at.tolist() == list(range(len(bpe.entries))) and sorted(bpe.hash.slot_item) == list(range(len(bpe.entries)))
    for items in ([b"a"], [b"a", b"b", b"ab"]):
        assert byte_bpe.PerfectHash(items).slots(items).tolist() == list(range(len(items)))


def test_against_library(pair):
    bpe, library = pair
    r = random.Random(1)
    texts = ["", " ", "\n\n  x", "don't we'LL", "<|endoftext|>", "a" * 5000, "ab" * 3000 + "é" * 500, "\U0001f600‍\U0001f525", "\x00\x85 ﻿", "0123456789 " * 50]
    alphabet = "abcdefghij   \n\téß中ا\U0001f600.,!?'0123ſḰ"
    texts += ["".join(r.choice(alphabet) for _ in range(r.randint(1, 80))) for _ in range(2000)]
    for t in texts:
        want = library.encode_ordinary(t)
        assert bpe.encode(t) == want, t
        assert bpe.decode(want) == t.encode()
    for c in range(0x110000):
        if c % 7 == 0 and not 0xD800 <= c < 0xE000:
            t = f"a {chr(c)} b{chr(c)}1"
            assert bpe.encode(t) == library.encode_ordinary(t), hex(c)


def test_slices_and_memo(pair, monkeypatch):
    bpe, library = pair
    monkeypatch.setattr(byte_bpe, "SLICE", 7)
    monkeypatch.setattr(byte_bpe, "MEMO_BYTES", 900)
    t = "the quick brown foxes jumpinggg over thhhe lazy dogs " * 9
    texts = [t, "", "a", t[:30], "\n", "", t]
    for x, got in zip(texts, bpe.digests(texts)):
        want = library.encode_ordinary(x)
        assert got == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(x.encode()).hexdigest())


def test_memo_is_bounded_by_bytes(pair):
    bpe, library = pair
    r = random.Random(3)
    word = lambda n: "".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(n))
    for k in range(60):
        t = " ".join(word(r.randint(5, 40)) for _ in range(2000)) + " " + word(30000)
        assert not k or len(bpe.encode(t)) > 10000
        assert max(map(len, bpe.memo)) <= byte_bpe.KEPT and bpe.held <= byte_bpe.MEMO_BYTES + (4 << 20)
    assert bpe.encode(t) == library.encode_ordinary(t)


def test_query(spark, pair):
    bpe, library = pair
    assert pickle.loads(pickle.dumps(bpe)).encode("hello thereouw") == library.encode_ordinary("hello thereouw")
    rows = [(1, "hello thereouw", 0), (2, None, 0), (None, "", 0), (1, "hello thereouw", 0)]
    got = byte_bpe.encode_digests(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), bpe).collect()
    empty, n = hashlib.sha256(b"").hexdigest(), len(library.encode_ordinary("hello thereouw"))
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"] == empty) for r in got), key=str) == [(1, n, False), (1, n, False), (2, 0, True), (None, 0, True)]
    ids = byte_bpe.with_ids(spark.createDataFrame(rows, "doc_id long, text string, token_ids int"), bpe).collect()
    assert [r["token_ids"] for r in ids] == [library.encode_ordinary(t or "") for _, t, _ in rows]
    assert byte_bpe.encode_digests(spark.createDataFrame([], "doc_id long, text string"), bpe).count() == 0
