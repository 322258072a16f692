"""Importance resampling against counts by dictionaries, one document at a time."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from spinlattice.llm import importance

from .test_operators import DOC, make_texts

BENCH = ["The tion ing tion. the", "Éa st 12 lo", "x" * 3000, None, ""]


def grams_of(text):
    low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [zlib.crc32(g.encode()) % 10000 for g in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]]


def brute(rows, bench, percent, seed, least=20):
    s, t = [0] * 10000, [0] * 10000
    grams = [(d, *grams_of(x)) for d, x in rows]
    for _, _, g in grams:
        for b in g:
            s[b] += 1
    for x in bench:
        for b in grams_of(x)[1]:
            t[b] += 1
    top, low = sum(s) + 10000, sum(t) + 10000
    gain = [math.floor(1000 * math.log((b + 1) * top / ((a + 1) * low))) for a, b in zip(s, t, strict=True)]
    out = []
    for d, w, g in grams:
        weight = sum(gain[b] for b in g) // len(g) if g else 0
        score = None
        if d is not None:
            h = int(hashlib.sha256(f"{seed}:{d}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        out.append([d, len(w), len(g), weight, score, None])
    fit = sorted((r for r in out if r[1] >= least and r[4] is not None), key=lambda r: (-r[4], r[0]))
    for i, r in enumerate(fit[: percent * len(fit) // 100]):
        r[5] = i + 1
    return sorted(map(tuple, out), key=str)


def test_checksums_of_joined_words():
    rng = np.random.default_rng(0)
    a, b = ([bytes(rng.integers(0, 256, n, np.uint8)) for n in rng.integers(0, 200, 300)] for _ in range(2))
    crc = lambda xs: np.array([zlib.crc32(x) for x in xs], np.uint32)
    assert (importance.appended(crc(a), crc(b), np.array([len(x) for x in b])) == crc([x + y for x, y in zip(a, b, strict=True)])).all()


@pytest.mark.parametrize("order", [1, 2, 3])
def test_no_gram_crosses_a_text(order):
    rng = random.Random(order)
    texts = [" ".join(rng.choice(["a", "B1", "é", "\n", "."]) for _ in range(rng.randint(0, 9))) for _ in range(200)]
    bucket, whose, n_words = importance.Features(order, 1 << 20).of(pa.array([t.encode() for t in texts], pa.large_binary()))
    for i, t in enumerate(texts):
        words = grams_of(t)[0]
        want = [zlib.crc32(" ".join(words[k : k + n]).encode()) % (1 << 20) for n in range(1, order + 1) for k in range(len(words) - n + 1)]
        assert sorted(bucket[whose == i].tolist()) == sorted(want) and n_words[i] == len(words)


def test_resample(spark):
    texts = [*make_texts(), "word " * 200_000]
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(5, texts[5]), (9, texts[-2]), (9, texts[-2])]
    docs = spark.createDataFrame([(d, t, "en", "s", 0, "x", 1) for d, t in rows], DOC + ", weight string, rank int").repartition(7)
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(BENCH)], "item_id long, text string")
    for percent in (0, 25, 100):
        got = importance.resample(docs, bench, percent, 7)
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows, BENCH, percent, 7)


def test_resample_favours_the_target(spark):
    rng = random.Random(5)
    prose = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    near, far = ["alpha", "beta", "gamma", "delta"], ["one", "two", "three", "four"]
    docs = spark.createDataFrame([(i, prose(near if i % 4 == 0 else far, 50)) for i in range(400)], "doc_id long, text string")
    bench = spark.createDataFrame([(prose(near, 60),) for _ in range(20)], "text string")
    drawn = importance.resample(docs, bench, 20, 1).where("rank is not null").collect()
    assert len(drawn) == 80 and sum(r["doc_id"] % 4 == 0 for r in drawn) >= 75


def test_empty_tables(spark):
    nothing = spark.createDataFrame([], DOC)
    docs = spark.createDataFrame([(1, "a b " * 30), (2, None)], "doc_id long, text string")
    assert importance.resample(nothing, docs, 25, 7).count() == 0
    assert sorted(map(tuple, importance.resample(docs, nothing, 100, 7).collect()), key=str) == brute([(1, "a b " * 30), (2, None)], [], 100, 7)
