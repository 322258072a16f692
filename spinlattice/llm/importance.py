"""Target-distribution importance resampling: documents drawn by how much likelier their hashed n-grams are in a target.

Texts of a step are joined to one string of bytes with a sentinel between them; one regex pass finds all words of it, ``searchsorted``
against the documents' ends says whose each word is, and n-grams whose first and last word differ in that are masked before the
buckets are counted. An n-gram's bucket is the CRC-32 of its bytes, which numpy composes from the checksums of its
words: the register after a longer text is a linear function of the register before, so appending a word of known
length is four table lookups.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

c = F.col
#: Words of lower-cased bytes: digits, letters and everything beyond ASCII; line feeds stand between texts.
WORD, SENTINEL = rb"[0-9a-z\x80-\xff]+", b"\n"
#: n-grams of 1 to ORDER words, hashed to BUCKETS; a document of fewer than LEAST words is not drawn.
ORDER, BUCKETS, LEAST = 2, 10_000, 20
#: Bytes of text that are worked on at a time.
STEP_BYTES = 1 << 20
#: Words up to so many bytes are appended all at once, longer ones one by one.
SHORT = 64


@lru_cache(maxsize=1)
def _crc_table() -> np.ndarray:
    """The register's change for each low byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> np.uint32(1)), table >> np.uint32(1))
    return table


@lru_cache(maxsize=1024)
def _zeros(n: int) -> np.ndarray:
    """What ``n`` zero bytes make of a register that has one byte set: 4 tables of 256, by place and value of that byte."""
    if n <= 0:
        return np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    if n == 1:
        start, table = _zeros(0), _crc_table()
        return table[start & np.uint32(0xFF)] ^ (start >> np.uint32(8))
    half = _zeros(n // 2)
    twice = apply_zeros(half, half)
    return twice if n % 2 == 0 else apply_zeros(_zeros(1), twice)


def apply_zeros(tables: np.ndarray, register: np.ndarray) -> np.ndarray:
    out = tables[0][register & np.uint32(0xFF)]
    for k in range(1, 4):
        out = out ^ tables[k][(register >> np.uint32(8 * k)) & np.uint32(0xFF)]
    return out


@lru_cache(maxsize=1)
def _short_tables() -> np.ndarray:
    """The tables of 0 to SHORT zero bytes in a row."""
    return np.stack([_zeros(n) for n in range(SHORT + 1)]).reshape(-1)


def appended(crc: np.ndarray, tail: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of two texts in a row: ``crc`` is the first's, ``tail`` and ``sizes`` the second's and its bytes."""
    flat = _short_tables()
    base = np.minimum(sizes, SHORT).astype(np.int64) * 1024
    out = flat[base + (crc & np.uint32(0xFF))]
    for k in range(1, 4):
        out ^= flat[base + (256 * k + ((crc >> np.uint32(8 * k)) & np.uint32(0xFF)))]
    for i in np.flatnonzero(sizes > SHORT).tolist():
        out[i] = apply_zeros(_zeros(int(sizes[i])), crc[i : i + 1])[0]
    return out ^ tail


class Features:
    """Buckets of the n-grams of texts."""

    def __init__(self, order: int = ORDER, buckets: int = BUCKETS):
        self.order, self.buckets, self.find = order, buckets, re.compile(WORD).finditer

    def words(self, texts: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """The texts in one string, where its words start and end, and whose text each is."""
        raw = [x.as_py() for x in texts]
        joined = SENTINEL.join(raw).lower()
        places = np.fromiter(chain.from_iterable(map(re.Match.span, self.find(joined))), np.int64)
        starts, ends = places[::2], places[1::2]
        owner = np.searchsorted(np.cumsum([len(r) + len(SENTINEL) for r in raw]), starts, "right")
        return joined, starts, ends, owner

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bucket, text) of every n-gram of binary texts, n by n, and the number of words of each text."""
        joined, starts, ends, owner = self.words(texts)
        spelled = map(joined.__getitem__, map(slice, starts.tolist(), ends.tolist()))
        one = np.fromiter(map(zlib.crc32, spelled), np.uint32, len(starts))
        sizes, gram = ends - starts, one
        buckets, whose = [one % np.uint32(self.buckets)], [owner]
        space = np.uint32(zlib.crc32(b" "))
        for n in range(1, self.order):
            head = appended(gram[:-1], np.full(max(len(gram) - 1, 0), space), np.ones(max(len(gram) - 1, 0), np.int64))
            gram = appended(head, one[n:], sizes[n:])
            inside = owner[: len(gram)] == owner[n:]  # else it would cross from one document to the next
            buckets.append((gram % np.uint32(self.buckets))[inside])
            whose.append(owner[: len(gram)][inside])
        return np.concatenate(buckets), np.concatenate(whose), np.bincount(owner, minlength=len(texts))


def _steps(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Stretches of rows of about STEP_BYTES, a longer row alone."""
    total, at = np.cumsum(pc.binary_length(texts).to_numpy()), 0
    while at < len(texts):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + STEP_BYTES, "right")))
        yield at, to
        at = to


def bucket_counts(docs: DataFrame, text: str = "text", order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: the n-grams of all texts by bucket. A task adds up its own rows first; nulls have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = Features(order, buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            texts = pc.fill_null(batch.column(0), b"").cast(pa.large_binary())
            for at, to in _steps(texts):
                total += np.bincount(own.of(texts[at:to])[0], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(held, pa.int32()), "n": pa.array(total[held], pa.int64())})

    rows = docs.select(c(f"`{text}`").cast("string").cast("binary").alias("t"))
    return rows.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS, scale: int = 1000) -> np.ndarray:
    """floor(scale * ln of how much likelier a bucket is in the target), add-one smoothed. ``buckets`` numbers reach the driver."""
    import math

    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for counts, into in ((source, s), (target, t)):
        for r in counts.collect():  # at most ``buckets`` rows
            into[r["bucket"]] = r["n"]
    total = float(s.sum() + buckets), float(t.sum() + buckets)
    odds = [(float(b + 1) * total[0]) / (float(a + 1) * total[1]) for a, b in zip(s.tolist(), t.tolist(), strict=True)]
    return np.array([math.floor(scale * math.log(x)) for x in odds], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """doc_id, n_words, n_features, weight: the floored mean of the gains over a document's n-grams (0 without any)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Features(order, len(gain))
        for batch in batches:
            texts = pc.fill_null(batch.column(1), b"").cast(pa.large_binary())
            for at, to in _steps(texts):
                bucket, whose, n_words = own.of(texts[at:to])
                n = np.bincount(whose, minlength=to - at)
                total = np.zeros(to - at, np.int64)
                np.add.at(total, whose, gain[bucket])
                cols = [n_words, n, np.where(n > 0, total // np.maximum(n, 1), 0)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[at:to], *(pa.array(x, pa.int64()) for x in cols)], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(c(f"`{key}`").cast("long").alias("k"), c(f"`{text}`").cast("string").cast("binary").alias("t"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(key: Column, seed: int, scale: int = 1000) -> Column:
    """A Gumbel draw that depends on nothing but seed and key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(float(-scale)) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def numbered_rows(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with their place (1, 2, 3, ...) in the whole order as ``rank``: sorted ranges, each with the number of rows before it."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    table = materialize(dealt, name).withColumn("_part", F.shiftright("_at", 33).cast("int"))
    before, offsets = 0, []
    for r in sorted(table.groupBy("_part").count().collect()):  # one row a range
        offsets.append((r["_part"], before))
        before += r["count"]
    known = rows.sparkSession.createDataFrame(offsets, "_part int, _before long")
    rank = c("_before") + c("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return table.join(F.broadcast(known), "_part").withColumn("rank", rank).drop("_part", "_at", "_before")


def resample(
    docs: DataFrame, target: DataFrame, percent: int, seed: int, key: str = "doc_id", text: str = "text", least: int = LEAST, order: int = ORDER, buckets: int = BUCKETS
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of ``docs``: those drawn, ``percent`` of the rows with ``least`` words
    or more, are ranked by score from 1 on, ties to smaller ids; all others have no rank.

    Null and empty texts have no n-grams: weight 0, never drawn where ``least`` is above 0. Rows without an id are counted and weighed but have no draw: score null, no rank,
    not among those of which ``percent`` is taken. Rows that repeat an id draw the same noise; equal in score and id, they come by weight,
    then in any order. Other columns, whatever their names, are not read. With an empty target every gain speaks against frequent buckets alike;
    an empty table gives an empty one. A very long text is one step of its own."""
    gain = gains(bucket_counts(docs, text, order, buckets), bucket_counts(target, text, order, buckets), buckets)
    scored = weigh(docs, gain, key, text, order).withColumn("score", c("weight") + noise(c("doc_id"), seed))
    scored = materialize(scored, "importance-scores")
    fit = (c("n_words") >= least) & c("score").isNotNull()
    chance, other = scored.where(fit), scored.where(~fit)
    ranked = numbered_rows(chance, [c("score").desc(), c("doc_id").asc(), c("weight").desc(), c("n_words").desc()], "importance-ranks")
    drawn = percent * chance.count() // 100
    ranked = ranked.withColumn("rank", F.when(c("rank") <= drawn, c("rank")))
    return ranked.unionByName(other.withColumn("rank", F.lit(None).cast("long")))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    got = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 25, 7)
    return got.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


__all__ = ["Features", "bucket_counts", "gains", "op11_importance", "resample", "weigh"]
