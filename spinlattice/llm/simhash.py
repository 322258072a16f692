"""SimHash near-duplicates with pigeonring candidate filtering.

A fingerprint has 64 bits in three ring segments of 21, 21 and 22 bits. If two differ in
at most two bits, then from some segment on the running sums of the segments' differences
stay within the proportional budgets 2/3, 4/3 and 2: no difference in the first segment
of that chain, at most one in the first two together, at most two in all. The first two
conditions are an equi-join: the two segments' bits on one side against the same bits with none
or one of the second segment's flipped on the other. The last is the full Hamming check.
Only distinct fingerprints take part, so copies never multiply; a fingerprint has
at most 2,080 true partners however many documents there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_hot, materialize, table
from .components import components

SEGMENTS = (range(0, 21), range(21, 42), range(42, 64))
DISTANCE = 2


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of the word shingles, repeats included."""
    import xxhash

    w = (text or "").encode().lower().split()  # bytes: ASCII letters and white space only
    if not w:
        return 0
    join = b" ".join
    if len(w) <= shingle:
        parts = [join(w)]
    elif shingle == 3:
        parts = [b"%b %b %b" % x for x in zip(w, w[1:], w[2:], strict=False)]
    else:
        parts = [join(x) for x in zip(*(w[k:] for k in range(shingle)), strict=False)]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(p, 42) for p in parts], np.uint64)
    total = np.zeros(64, np.int64)
    for k in range(0, len(h), 65536):
        total += np.unpackbits(h[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long); null and empty texts have 0."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            fps = np.array([fingerprint(None if pd.isna(t) else t) for t in pdf["t"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": pdf["k"].astype("Int64"), "fp": fps})

    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInPandas(run, "doc_id long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _masks() -> list[tuple[int, int, list[int]]]:
    """Of each chain start: its number, the bits of its two segments, flips of the second."""
    bits = [sum(1 << b for b in s) for s in SEGMENTS]
    out = []
    for i in range(3):
        j = (i + 1) % 3
        out.append((i, _signed(bits[i] | bits[j]), [0, *(_signed(1 << b) for b in SEGMENTS[j])]))
    return out


def links(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints (column fp) at most two bits apart."""
    chains = F.array(*(F.struct(F.lit(i).alias("chain"), F.lit(m).alias("mask"), F.array(*map(F.lit, flips)).alias("flips")) for i, m, flips in _masks()))
    base = distinct.select("fp", F.explode(chains).alias("c"))
    left = base.select(F.col("fp").alias("a"), F.col("c.chain").alias("chain"), F.col("fp").bitwiseAND(F.col("c.mask")).alias("bits"))
    right = base.select(F.col("fp").alias("b"), "c.chain", F.col("fp").bitwiseAND(F.col("c.mask")).alias("at"), F.explode("c.flips").alias("flip"))
    right = right.select("b", "chain", F.col("at").bitwiseXOR(F.col("flip")).alias("bits"))
    # sizes before the explosion say nothing about those behind it: never broadcast by estimate
    pairs = left.hint("merge").join(right, ["chain", "bits"]).where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp, component_id (least doc_id of the linked group), a row for each row of ``docs``.

    Null and empty texts have fingerprint zero and link like any other. Null keys are
    never a group's id unless the group has no other; repeated keys are rows of their own. Other columns, whatever their names, are
    not read. No rows give no rows.
    """
    fps = materialize(fingerprints(docs, key, text), "simhash")
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "simhash-classes")
    groups = components(links(classes.select("fp")))
    of_class = classes.join(groups, classes["fp"] == groups["node"], "left").select("fp", "least", "copies", F.coalesce("component", "fp").alias("component"))
    of_class = materialize(of_class, "simhash-groups")
    # a fingerprint that most rows have and a component of most fingerprints are joined in parts
    least = materialize(of_class.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("classes")), "simhash-least")
    named = materialize(join_hot(of_class, least, "component", "classes", F.col("fp")).select("fp", "component_id", "copies"), "simhash-named")
    return join_hot(fps, named, "fp", "copies", F.col("doc_id")).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each group of near-duplicates the document with the least doc_id, with all its columns.

    Repeated rows of one doc_id share their fate; rows without a doc_id stay."""
    kept = near_duplicates(docs).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id is null")).select(*docs.columns)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
