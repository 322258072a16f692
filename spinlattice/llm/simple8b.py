"""Token ids in a Simple-8b word-aligned format.

File format: a Parquet container, so that Spark's commit protocol, column pruning and any
Hadoop file system apply. A row is a segment of consecutive documents:

* ``shard`` int, ``segment`` long: place in the order; shard k holds smaller keys than k + 1
* ``start`` long: ids of the shard before this segment, ``n_ids`` long
* ``doc_ids`` array<long>, ``doc_lengths`` array<long>
* ``payload`` binary, little-endian: 4 bytes ``S8B1``; u32 number of blocks, escapes and
  words; u64 number of ids; u32[blocks + 1] first word of each block; u64[escapes] values
  of 2**60 or more; u64[words].

A word has a 4-bit selector on top. Selector s of 0 to 13 packs COUNTS[s] ids of BITS[s] bits, the
first lowest; 15 is an escape, the word's low bits then give the place in the escape table.
Every block of BLOCK ids starts with a word of its own, so blocks decode independently
and both directions work on all blocks of a segment at once in numpy.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path

# fixed values: the packings of a 60-bit word
COUNTS = [60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1]
BITS = [1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60]
ESCAPE = 15
BLOCK = 1024
#: Ids that a segment has, about; a document is never split.
SEGMENT = 1 << 19

SCHEMA = "shard int, segment long, start long, n_ids long, doc_ids array<long>, doc_lengths array<long>, payload binary"


def pack(ids: np.ndarray) -> bytes:
    """Greedy packing: each word takes as many ids as fit. Blocks advance together."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    blocks = -(-n // BLOCK)
    limit = np.minimum(np.arange(1, blocks + 1) * BLOCK, n)
    # the word that would start at each place: the widest packing whose ids all fit
    step, kind = np.ones(n, np.int32), np.full(n, ESCAPE, np.uint8)
    narrow, widest = np.arange(n, dtype=np.int32), int(ids.max()) if n else 0
    room = np.minimum(BLOCK - (narrow & BLOCK - 1), n - narrow)  # ids left in the block
    small = ids.astype(np.uint32) if widest < 1 << 32 else ids
    for s in reversed(range(len(COUNTS))):
        count, bits = COUNTS[s], BITS[s]
        if widest >> bits:
            narrow = narrow[small[narrow] < 1 << bits]
        if len(narrow) < count:
            break
        if len(narrow) == n:
            first = np.flatnonzero(room >= count)
        else:
            first = narrow[: len(narrow) - count + 1]
            first = first[narrow[count - 1 :] - first == count - 1]
            first = first[room[first] >= count]
        step[first], kind[first] = count, s
    at, live = np.arange(blocks) * BLOCK, np.arange(blocks)
    rows_block, rows_at = [], []
    while len(live):
        here = at[live]
        rows_block.append(live)
        rows_at.append(here)
        at[live] = here + step[here]
        live = live[at[live] < limit[live]]
    block = np.concatenate(rows_block) if rows_block else np.zeros(0, np.int64)
    start = np.concatenate(rows_at) if rows_at else np.zeros(0, np.int64)
    order = np.argsort(start, kind="stable")  # block order and place order are the same
    block, start = block[order], start[order]
    sel = kind[start] if n else np.zeros(0, np.uint8)
    word = sel.astype(np.uint64) << np.uint64(60)
    for s, (count, bits) in enumerate(zip(COUNTS, BITS, strict=True)):
        rows = np.flatnonzero(sel == s)
        if len(rows):
            first, packed = start[rows], word[rows]
            for k in range(count):
                packed |= ids[first + k] << np.uint64(k * bits)
            word[rows] = packed
    rows = np.flatnonzero(sel == ESCAPE)
    word[rows] |= np.arange(len(rows), dtype=np.uint64)
    escapes = ids[start[rows]] if n else np.zeros(0, np.uint64)
    offsets = np.searchsorted(block, np.arange(blocks + 1)).astype("<u4")
    head = b"S8B1" + struct.pack("<IIIQ", blocks, len(escapes), len(word), n)
    return head + offsets.tobytes() + escapes.astype("<u8").tobytes() + word.astype("<u8").tobytes()


def unpack(payload: bytes) -> np.ndarray:
    """All ids of a segment as uint64."""
    if payload[:4] != b"S8B1":
        raise ValueError("not a Simple-8b segment")
    blocks, n_escapes, n_words, n = struct.unpack_from("<IIIQ", payload, 4)
    at = 24 + 4 * (blocks + 1)
    escapes = np.frombuffer(payload, "<u8", n_escapes, at)
    word = np.frombuffer(payload, "<u8", n_words, at + 8 * n_escapes)
    sel = (word >> np.uint64(60)).astype(np.int64)
    counts = np.array([*COUNTS, 0, 1])[sel]
    start = np.cumsum(counts) - counts
    out = np.empty(n, np.uint64)
    for s, (count, bits) in enumerate(zip(COUNTS, BITS, strict=True)):
        rows = np.flatnonzero(sel == s)
        if len(rows):
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(bits)
            fields = word[rows, None] >> shifts & np.uint64((1 << bits) - 1)
            out[start[rows, None] + np.arange(count)] = fields
    rows = np.flatnonzero(sel == ESCAPE)
    out[start[rows]] = escapes[(word[rows] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out


def unpack_block(payload: bytes, block: int) -> np.ndarray:
    """One block of a segment, found by its offset; nothing before it is decoded."""
    blocks, n_escapes, _, n = struct.unpack_from("<IIIQ", payload, 4)
    offsets = np.frombuffer(payload, "<u4", blocks + 1, 24)
    at = 24 + 4 * (blocks + 1) + 8 * n_escapes
    a, b = int(offsets[block]), int(offsets[block + 1])
    ids = min(BLOCK, n - block * BLOCK)
    head = b"S8B1" + struct.pack("<IIIQ", 1, n_escapes, b - a, ids) + struct.pack("<II", 0, b - a)
    return unpack(head + payload[at - 8 * n_escapes : at] + payload[at + 8 * a : at + 8 * b])


def _segments(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts consecutive documents, given where their ids end, into runs of about SEGMENT ids (at least a document)."""
    a = 0
    while a < len(ends):
        done = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, done + SEGMENT, "right")))
        yield a, b
        a = b


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int | None = 2, key: str = "doc_id", text: str = "text") -> None:
    """Encode whole texts and write them in ascending key order.

    One range shuffle puts the documents in order; encoding and packing then run on each
    partition as a stream, in segments of about SEGMENT ids. Null texts are empty, null keys
    come first, repeated keys keep all their rows, a table without rows gives no segment. Other columns, whatever their
    names, are not read. A very long text is cut at white space into stretches; its ids are held whole.
    """

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        from .word_tokens import encoder

        encode_all, shard, start, segment = encoder(tokenizer).encode, TaskContext.get().partitionId(), 0, 0
        tail = np.zeros(0, np.uint32) if end_id is None else np.array([end_id], np.uint32)
        for batch in batches:
            keys, done = batch.column("k"), 0
            for ids, lengths in encode_all(batch.column("t")):
                ends = np.cumsum(lengths)
                ids = np.insert(ids.astype(np.uint32), ends, tail[0]) if len(tail) else ids
                lengths, ends = lengths + len(tail), ends + len(tail) * np.arange(1, len(lengths) + 1)
                for a, b in _segments(ends):
                    first = ends[a - 1] if a else 0
                    part = ids[first : ends[b - 1]]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "shard": pa.array([shard], pa.int32()), "segment": [segment], "start": [start], "n_ids": [len(part)],
                            "doc_ids": pa.array([keys[done + a : done + b].to_pylist()], pa.list_(pa.int64())), "doc_lengths": pa.array([lengths[a:b]], pa.list_(pa.int64())), "payload": pa.array([pack(part)], pa.binary()),
                        }
                    )
                    start, segment = start + len(part), segment + 1
                done += len(lengths)

    ordered = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).repartitionByRange(F.col("k").asc_nulls_first())
    ordered.sortWithinPartitions(F.col("k").asc_nulls_first()).mapInArrow(encode, SCHEMA).write.mode("errorifexists").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a token file: doc_id, start (ids before it in the whole file), n_tokens,
    ids_crc32, ids (little-endian unsigned 64-bit bytes are kept out: ids are 32-bit here)."""
    return _decode(spark, path, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<long>", True)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """As :func:`read_tokens` without the ids themselves."""
    return _decode(spark, path, "doc_id long, start long, n_tokens long, ids_crc32 long", False)


def _decode(spark: SparkSession, path: str, schema: str, with_ids: bool) -> DataFrame:
    def decode(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for row in pdf.itertuples():
                ids = unpack(row.payload)
                ends = np.cumsum(np.array(row.doc_lengths, np.int64))
                starts = ends - np.array(row.doc_lengths, np.int64)
                narrow = ids.astype("<u4") if not len(ids) or ids.max() < 1 << 32 else ids.astype("<u8")
                cut = [narrow[a:b] for a, b in zip(starts, ends, strict=True)]
                out = {"doc_id": pd.array(list(row.doc_ids), "Int64"), "start": row.before + row.start + starts, "n_tokens": ends - starts, "ids_crc32": [zlib.crc32(x.tobytes()) for x in cut]}
                yield pd.DataFrame(out | ({"ids": [x.astype(np.int64) for x in cut]} if with_ids else {}))

    rows = spark.read.schema(SCHEMA).parquet(path)
    # a row for each shard, however large the shards: the number of output partitions
    totals = rows.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(before), "shard").select("before", "start", "doc_ids", "doc_lengths", "payload").mapInPandas(decode, schema)


def op1_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    path = new_path(spark, "op1-tokens")
    write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return read_digests(spark, path)
