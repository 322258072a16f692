"""Manifests and proofs against trees built level by level in lists."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from spinlattice.llm import merkle

ROW = "doc_id long, source string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes, fanout):
    """The root of nodes and each one's (before, after) on every level."""
    proofs, below = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, leaves = [], []
        for at in range(0, len(nodes), fanout):
            run = nodes[at : at + fanout]
            for k in range(len(run)):
                for i in below[at + k]:
                    proofs[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(sha("".join(run)))
            leaves.append(sum(below[at : at + fanout], []))
        nodes, below = up, leaves
    return nodes[0], proofs


def brute(rows, fanout):
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[1]].append((r[0], leaf_of(r)))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by_source[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = climb([h for _, h in by_source[s]], fanout)
    root, top = climb([trees[s][0] for s in names], fanout)
    return root, sorted((str(s), str(d), h, trees[s][0], p + t) for s, t in zip(names, top, strict=True) for (d, h), p in zip(by_source[s], trees[s][1], strict=True))


def shown(df):
    return sorted((str(r["source"]), str(r["doc_id"]), r["hash"], r["subroot"], [tuple(p) for p in r["proof"]]) for r in df.collect())


@pytest.mark.parametrize(("fanout", "every"), [(2, 1), (2, 3), (3, 2), (16, 2)])
def test_proofs(spark, fanout, every):
    rng = random.Random(fanout * 10 + every)
    sizes = {None: 3, "": 1, "é": 17, "hot": 300, "b": 16, "Z": fanout**every, "z": fanout**every + 1}
    rows = [(rng.choice([None, rng.randint(-3, 10**6)]) if n > 20 else i, s, rng.choice([None, "", "Text é", "x" * 5000])) for s, n in sizes.items() for i in range(n)]
    rows += rows[:5]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], ROW + ", hash string, idx int").repartition(11)
    manifest = merkle.build_manifest(docs, ["doc_id", "source", "text"], fanout=fanout, every=every)
    root, want = brute(rows, fanout)
    got = merkle.proofs(manifest)
    assert manifest.root == root and shown(got) == want
    assert got.where(merkle.folded(F.col("hash"), F.col("proof")) != root).count() == 0
    assert got.where(merkle.folded(F.sha2(F.lit("other"), 256), F.col("proof")) == root).count() == 0


def test_many_sources(spark):
    rows = [(i, f"s{i % 700}" if i % 50 else None, None) for i in range(1500)]
    manifest = merkle.build_manifest(spark.createDataFrame(rows, ROW), ["doc_id", "source", "text"])
    root, want = brute(rows, 16)
    assert manifest.root == root and shown(merkle.proofs(manifest)) == want


def test_only_every_other_level_is_stored(spark):
    rows = [(i, "s", "t") for i in range(5000)]
    tree = merkle.build_manifest(spark.createDataFrame(rows, ROW), ["doc_id", "source", "text"]).leaves
    assert [t.selectExpr("sum(size(kids))").first()[0] for t in tree.stored] == [5000, 20]  # not the 313 and the 2 between


def test_empty_and_single(spark):
    nothing = merkle.build_manifest(spark.createDataFrame([], ROW), ["doc_id", "source", "text"])
    assert nothing.root is None and merkle.proofs(nothing).count() == 0
    one = merkle.build_manifest(spark.createDataFrame([(None, None, None)], ROW), ["doc_id", "source", "text"])
    assert one.root == sha("---") and [tuple(r["proof"]) for r in merkle.proofs(one).collect()] == [()]
