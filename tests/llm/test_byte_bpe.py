"""Byte-level BPE against the tiktoken library, and decoding against the texts."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from spinlattice.llm import byte_bpe

from .test_operators import DOC, make_texts

RANKS = [public_tokenizers.path(x) for x in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken")]


def library(path):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})


def awkward():
    rng = random.Random(2)
    letters = [*"aab cd \n\t'st", "é", "ß", "漢", "字", "\U0001f600", "‍", "́", "\x00", "\xa0", " ", "1", "٣", "-", "="]
    return make_texts() + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(500)] + ["a" * 40_000, " " * 999, "=-" * 5000, "é" * 3000, "漢字" * 20_000]


@pytest.mark.parametrize("path", RANKS)
def test_ids_are_the_librarys(path):
    own, texts = byte_bpe.ByteBpe(path, most=400), [t or "" for t in awkward()]
    want = library(path)
    for at in range(0, len(texts), 50):
        ids, lengths = own.encode(texts[at : at + 50])
        assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == [want.encode_ordinary(t) for t in texts[at : at + 50]]


def test_documents_both_ways(spark):
    texts = awkward()
    rows = [(i if i % 7 else None, t, "en", "s", 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, [1], "x") for r in rows], DOC + ", ids array<int>, decoded string").repartition(4)
    want, kept = library(RANKS[0]), spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n long, text string")
    encoded = byte_bpe.encode_documents(kept, RANKS[0], offsets=True, key="n")
    back = {r["doc_id"]: r for r in byte_bpe.decode_documents(encoded.withColumn("held", F.col("ids")), RANKS[0]).collect()}
    assert len(back) == len(texts)
    for i, t in enumerate(texts):
        r, t = back[i], t or ""
        assert r["held"] == want.encode_ordinary(t) and bytes(r["decoded"]) == t.encode() and r["text"] == t and (r["n_head"], r["n_tail"]) == (0, 0)
        at, borders = 0, {len(t[:k].encode()): k for k in range(len(t) + 1)} if len(t) < 5000 else None
        if borders is None:
            continue
        split = 0
        for token, a, b in zip(r["held"], r["starts"], r["ends"], strict=True):
            size = len(want.decode_single_token_bytes(token))
            first = max(k for p, k in borders.items() if p <= at)
            last = min(k for p, k in borders.items() if p >= at + size)
            assert (a, b) == (first, last)
            split += at not in borders or at + size not in borders
            at += size
        assert r["n_split"] == split
    got = byte_bpe.encode_documents(docs, RANKS[0])  # keys that are null, other columns named like the new ones
    assert got.columns == ["doc_id", "ids", "n_split"] and sorted(map(str, (r["ids"] for r in got.collect()))) == sorted(str(want.encode_ordinary(t or "")) for t in texts)


def test_windows_that_split_characters(spark):
    text = "漢\U0001f600é" * 40 + "뷁" * 30
    ids = library(RANKS[0]).encode_ordinary(text)
    for size in (1, 2, 3, 7):
        windows = spark.createDataFrame([(k, ids[k : k + size]) for k in range(0, len(ids), size)], "k int, ids array<int>")
        rows = sorted(byte_bpe.decode_documents(windows, RANKS[0]).collect())
        assert b"".join(bytes(r["decoded"]) for r in rows) == text.encode()
        for r in rows:
            raw = bytes(r["decoded"])
            inner = raw[r["n_head"] : len(raw) - r["n_tail"]]
            assert inner.decode() in text and r["text"].strip("�") == inner.decode()


def test_decoding_nothing_and_errors(spark):
    nothing = byte_bpe.encode_documents(spark.createDataFrame([], DOC), RANKS[0])
    assert nothing.count() == 0 and byte_bpe.decode_documents(nothing, RANKS[0]).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, []), (3, [0])], "decoded int, ids array<int>")
    assert sorted(bytes(r["decoded"]) for r in byte_bpe.decode_documents(nulls, RANKS[0]).collect()) == [b"", b"", b"!"]
    with pytest.raises(ValueError):
        byte_bpe.codec(RANKS[0], public_tokenizers.PATTERN).decode(np.array([60_000]))


def test_torn_ends():
    for raw, want in ((b"", (0, 0)), ("é".encode(), (0, 0)), ("é".encode()[1:], (1, 0)), ("漢".encode()[:2], (0, 2)), ("a漢".encode()[:2], (0, 1)), ("\U0001f600".encode()[1:], (3, 0)), (b"\xbf", (1, 0))):
        assert byte_bpe.torn_ends(raw) == want
