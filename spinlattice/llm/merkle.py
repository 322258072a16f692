"""Merkle manifest of a data set: a tree of hashes per source, one tree over the sources' roots, and a proof for every row.

Only every ``every``-th level is persisted, as blocks: one row holds the up to ``fanout ** every`` stored nodes of one aligned subtree. Proof
extraction goes through the stored levels from the top down; for each block it regenerates the missing levels from the stored
descendants, emits every child's siblings on them, and discards them. All hashing, folding and
grouping is Spark's; the driver holds the root and one row for each partition of the numbering.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, materialize

c = F.col
#: Nodes that are hashed to one, and levels from one stored level to the next.
FANOUT, EVERY = 16, 2
#: One group for the tree over the sources' roots.
TOP = "sources"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def field_text(column: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value: no two lists of values share one text."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_hash(*columns: Column) -> Column:
    return digest(F.concat(*map(field_text, columns)))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Each row's place ``idx`` (from 0) among its group's, ascending by ``order``, nulls first.

    Rows are dealt by ranges of (group, order), so that a group may be any share of them; a pass over a sorted
    range numbers it, and what stands before it in its first group comes from one row a range."""
    spark = rows.sparkSession
    place = rows.columns.index(group)
    dealt = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        part, before, run, local = TaskContext.get().partitionId(), None, -1, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            values = batch.column(place)
            fresh = np.ones(n, bool)
            if n > 1:
                a, b = values[1:], values[:-1]
                same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
                fresh[1:] = ~same.to_numpy(zero_copy_only=False)
            fresh[0] = run < 0 or values[0].as_py() != before
            runs = run + np.cumsum(fresh)
            starts = np.where(fresh, np.arange(n), -1)
            starts = np.maximum.accumulate(starts)
            locals_ = np.where(starts < 0, local + 1 + np.arange(n), np.arange(n) - starts)
            before, run, local = values[n - 1].as_py(), int(runs[-1]), int(locals_[-1])
            made = [pa.array(np.full(n, part), pa.int32()), pa.array(runs, pa.int64()), pa.array(locals_, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "_part", "_run", "_local"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    table = materialize(dealt.mapInArrow(count, f"{types}, _part int, _run long, _local long"), "merkle-numbered")
    ends = table.groupBy("_part").agg(F.min(F.struct("_run", "_local", group)).alias("a"), F.max(F.struct("_run", "_local", group)).alias("z"))
    offsets, held, n = [], None, 0
    for r in sorted(ends.collect(), key=lambda r: r["_part"]):  # one row a range
        first = n if offsets and r["a"][group] == held else 0
        offsets.append((r["_part"], first))
        held, n = r["z"][group], r["z"]["_local"] + 1 + (first if r["z"]["_run"] == 0 else 0)
    known = spark.createDataFrame(offsets, "_part int, _first long")
    idx = c("_local") + F.when(c("_run") == 0, c("_first")).otherwise(0)
    return table.join(F.broadcast(known), "_part").withColumn("idx", idx).drop("_part", "_run", "_local", "_first")


def runs_of(nodes: Column, fanout: int) -> Column:
    """The level above ``nodes``: every ``fanout`` consecutive ones, the last run being shorter, hashed to one."""
    n = F.ceil(F.size(nodes) / F.lit(fanout)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: digest(F.array_join(F.slice(nodes, i * fanout + 1, F.lit(fanout)), "")))


def ended(block: Column, nodes: Column) -> Column:
    """Whether ``nodes`` of this block are all of their group's: one node that is not hashed any further. Only a group's first block can tell:
    it is full where there is a second."""
    return (block == 0) & (F.size(nodes) == 1)


def levels_of(block: Column, nodes: Column, fanout: int, every: int, body) -> Column:
    """``body`` of the list of levels [nodes, the level above, ...], every + 1 of them, each computed once."""

    def up(have: list[Column]) -> Column:
        if len(have) > every:
            return body(have)
        last = have[-1]
        return let(F.when(ended(block, last), last).otherwise(runs_of(last, fanout)), lambda x: up([*have, x]))

    return let(nodes, lambda x: up([x]))


@dataclass
class Tree:
    """Stored levels, lowest first, each a table of (group, block, kids: array of struct with idx and hash)."""

    group: str
    fanout: int
    every: int
    stored: list[DataFrame] = field(default_factory=list)
    roots: DataFrame | None = None

    @classmethod
    def build(cls, rows: DataFrame, group: str, fanout: int = FANOUT, every: int = EVERY) -> Tree:
        """``rows`` have the group, idx (0, 1, 2, ... in each group), hash, and what else a leaf shall carry."""
        tree, span = cls(group, fanout, every), fanout**every
        while True:
            kids = F.struct("idx", *(x for x in rows.columns if x not in (group, "idx")))
            blocks = rows.groupBy(group, F.expr(f"idx div {span}").alias("block")).agg(F.sort_array(F.collect_list(kids)).alias("kids"))
            level = materialize(blocks, f"merkle-level-{len(tree.stored) * every}")
            tree.stored.append(level)
            top = levels_of(c("block"), c("kids.hash"), fanout, every, lambda have: F.get(have[-1], F.lit(0)))
            rows = level.select(group, c("block").alias("idx"), top.alias("hash"))
            if not level.where("block > 0").limit(1).count():
                tree.roots = rows.select(group, "hash")
                return tree

    def proofs(self, above: DataFrame) -> DataFrame:
        """A leaf's columns and ``proof``, an array of struct(before, after) from the leaf up. ``above`` has for each group what its root
        inherits: a ``proof`` and other columns, which all its leaves get."""
        up, carried = above.withColumn("idx", F.lit(0).cast("long")), [x for x in above.columns if x not in (self.group, "proof")]
        for level in reversed(self.stored):
            below = level.withColumnRenamed("block", "_block")
            at = up.select(c(self.group).alias("_group"), c("idx").alias("_at"), c("proof").alias("_above"), *carried)
            both = below.join(at, below[self.group].eqNullSafe(c("_group")) & (c("_block") == c("_at")))
            emit = levels_of(c("_block"), c("kids.hash"), self.fanout, self.every, self._emit)
            kids = both.select(self.group, "_above", *carried, F.explode(F.arrays_zip("kids", emit.alias("siblings"))).alias("_kid"))
            names = [f.name for f in level.schema["kids"].dataType.elementType.fields]
            up = kids.select(self.group, *carried, *(c(f"_kid.kids.{x}").alias(x) for x in names), F.concat("_kid.siblings", "_above").alias("proof"))
        return up.drop("idx")

    def _emit(self, have: list[Column]) -> Column:
        """For each child of a block its siblings on the levels of the block, which stand before and after it in its run."""
        k = self.fanout

        def siblings(i: Column) -> Column:
            out = []
            for j, nodes in enumerate(have[:-1]):
                at = F.floor(i / F.lit(k**j)).cast("int")
                left = (at % k).cast("int")
                before = F.array_join(F.slice(nodes, at - left + 1, left), "")
                after = F.array_join(F.slice(nodes, at + 2, k - 1 - left), "")
                out.append(F.when(~ended(c("_block"), nodes), F.struct(before.alias("before"), after.alias("after"))))
            return F.array_compact(F.array(*out))

        return F.transform(F.sequence(F.lit(0), F.size(have[0]) - 1), siblings)


@dataclass
class Manifest:
    """Trees of the sources and the tree of their roots; ``root`` is None for an empty table."""

    leaves: Tree
    sources: Tree
    root: str | None


def build_manifest(
    docs: DataFrame, columns: list[str], group: str = "source", order: str = "doc_id", carry: dict[str, Column] | None = None, fanout: int = FANOUT, every: int = EVERY,
) -> Manifest:
    """Hash ``columns`` of every row to a leaf and the leaves to trees.

    Leaves of a group ascend by ``order``, nulls first, rows with equal order by their hashes, so that the root does not depend on how the table is
    dealt; repeated rows are leaves of their own. Null groups are one group, the first. Nulls, empty and very long values have their own
    texts (``field_text``). Columns that are not named do not count, whatever their names; ``carry`` names further values of a row to
    keep beside its leaf. An empty table has no root and no proofs."""
    kept = docs.select(
        c(f"`{group}`").cast("string").alias("source"), c(f"`{order}`").cast("long").alias("doc_id"), leaf_hash(*(c(f"`{x}`") for x in columns)).alias("hash"),
        *(v.alias(n) for n, v in (carry or {}).items()),
    )
    rows = numbered(materialize(kept, "merkle-leaves"), "source", ["doc_id", "hash"])
    leaves = Tree.build(rows, "source", fanout, every)
    roots = materialize(leaves.roots.select(F.lit(TOP).alias("top"), "source", "hash"), "merkle-subroots")
    sources = Tree.build(numbered(roots, "top", ["source"]), "top", fanout, every)
    found = sources.roots.first()  # one row
    return Manifest(leaves, sources, found["hash"] if found else None)


def proofs(manifest: Manifest) -> DataFrame:
    """source, doc_id, hash, carried columns, subroot and proof of every leaf, the proof reaching to the manifest's root."""
    nothing = F.array().cast("array<struct<before:string,after:string>>")
    top = manifest.sources.roots.select("top", nothing.alias("proof"))
    above = manifest.sources.proofs(top).select("source", c("hash").alias("subroot"), "proof")
    return manifest.leaves.proofs(above)


def folded(leaf: Column, proof: Column) -> Column:
    """The root to which ``leaf`` leads along its proof."""
    return F.aggregate(proof, leaf, lambda acc, p: digest(F.concat(p["before"], acc, p["after"])))


def siblings_text(proof: Column) -> Column:
    return F.array_join(F.transform(proof, lambda p: F.concat(p["before"], p["after"])), "")


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, checked against texts of which every fifth, by the checksum of doc_id, has lost its capitals."""
    from .common import table

    docs = table(spark, sf_dir, "documents")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    other = leaf_hash(*(lowered if x == "text" else c(x) for x in FIELDS))
    tampered = F.when(F.crc32(c("doc_id").cast("string").cast("binary")) % 5 == 0, other)
    manifest = build_manifest(docs, FIELDS, carry={"tampered": tampered})
    root = F.lit(manifest.root).cast("string")
    got = proofs(manifest).select(
        "doc_id", c("hash").alias("leaf"), "subroot", root.alias("root"), digest(siblings_text(c("proof"))).alias("proof_sha256"),
        folded(F.coalesce("tampered", "hash"), c("proof")).alias("folded_root"),
    )
    return got.withColumn("verified", c("folded_root") == c("root"))


__all__ = ["Manifest", "Tree", "build_manifest", "folded", "leaf_hash", "op12_merkle", "proofs", "siblings_text"]
