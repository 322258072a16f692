"""Byte-level BPE encoding and decoding: rank files through the tokenizers library, over Arrow batches.

The library's models know letters, not bytes, so every byte is written as one printable letter (the byte table), and the rank file
becomes a vocabulary with one merge a token: the pair that the ranks themselves join last when they build it from its bytes. No other pair
can meet as that token: what happens inside a stretch of bytes until it is one token does not depend on what stands around it. Tokens that
are whole pattern matches are taken as they are (``ignore_merges``), as rank files ask for.

A step of texts is cut by the pattern; matches not seen before go to the library in one call, all others come from a bounded
store, and numpy lays ids and offsets out in text order. Decoding turns ids into letters' bytes by the reversed table; characters that a
token border or the end of an id list splits are put together again by bytes, or shown as U+FFFD where a part is missing.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .token_counts import PATTERN, byte_letters
from .word_tokens import Cache, ragged

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
#: Bytes of text that are worked on at a time, and pattern matches that the store holds.
STEP_BYTES, MOST_PIECES = 1 << 20, 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, of a file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def last_pair(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that ranks below the token's own leave of its bytes (None: more than two, it is then only met whole)."""
    parts, top = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        found = min((r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1], top)) <= top)
        if found[0] == top:
            return None
        parts[found[1] : found[1] + 2] = [parts[found[1]] + parts[found[1] + 1]]
    return (parts[0], parts[1])


class ByteBpe:
    """Encoder and decoder of one rank file; ``pattern`` cuts texts before any merge."""

    def __init__(self, path: str, pattern: str = PATTERN, most: int = MOST_PIECES):
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        ranks = read_ranks(path)
        letters = byte_letters()
        self.letter = np.array([ord(x) for x in letters], "<u4")
        self.byte = {x: b for b, x in enumerate(letters)}
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the rank file has no token for {len(missing)} single bytes")
        spell = lambda t: "".join(letters[b] for b in t)
        vocab = {spell(t): r for t, r in ranks.items()}
        pairs = (last_pair(t, ranks) for t, _ in sorted(ranks.items(), key=lambda x: x[1]) if len(t) > 1)
        merges = [(spell(p[0]), spell(p[1])) for p in pairs if p]
        self.library = Tokenizer(models.BPE(vocab=vocab, merges=merges, ignore_merges=True))
        self.library.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.library.model._resize_cache(0)  # the store below sees to it that no match comes twice
        self.find = regex.compile(pattern).findall
        self.store = Cache(most, self._learn, np.uint16 if max(ranks.values()) < 1 << 16 else np.uint32)
        # the byte table reversed: every id's letters as bytes, in a row
        spelled = [""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            spelled[i] = token
        self.n_bytes = np.array([len(s) for s in spelled], np.int64)
        self.first = np.cumsum(self.n_bytes) - self.n_bytes
        self.bytes = np.frombuffer(bytes(self.byte[x] for s in spelled for x in s), np.uint8)

    def _learn(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new matches in a row, and how many each has: one call, spaces between the matches' letters."""
        raw = [x.encode() for x in new]
        table = self.letter.copy()
        table[0xFF] = 32  # no byte of UTF-8, so it can separate
        spelled = table[np.frombuffer(b"\xff".join(raw), np.uint8)].tobytes().decode("utf-32-le")
        ids = np.array(self.library.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, np.int64)
        ends = np.searchsorted(np.cumsum(self.n_bytes[ids]), np.cumsum([len(r) for r in raw]), "left") + 1
        return ids, np.diff(ends, prepend=0)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of each text's."""
        pieces, n_pieces = [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            found = self.find(t)
            n_pieces[i] = len(found)
            pieces += found
        numbers = self.store.young.find(pieces)
        new = np.flatnonzero(numbers < 0)
        if len(new):  # a full store turns over here, and numbers may change
            distinct = list(dict.fromkeys(pieces if self.store.young.n + len(new) > self.store.most else [pieces[i] for i in new.tolist()]))
            self.store.numbers(distinct)
            numbers = self.store.young.find(pieces)
        ids, lengths = self.store.young.ids(numbers)
        before = np.concatenate([[0], np.cumsum(lengths)])
        ends = np.cumsum(n_pieces)
        return ids, before[ends] - before[ends - n_pieces]

    def spans(self, raw: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of consecutive texts' bytes and ids: the number of the character in which each id starts, that behind the character in
        which it ends (both counted from the first text's start), and whether it splits a character at either border."""
        chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # characters begun before each byte
        begins = np.append((raw & 0xC0) != 0x80, True)
        ends = np.cumsum(self.n_bytes[ids])
        starts = ends - self.n_bytes[ids]
        return chars[starts + 1] - 1, chars[ends], ~(begins[starts] & begins[ends])

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids in a row."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.n_bytes)):
            raise ValueError("an id is outside the vocabulary")
        return ragged(self.bytes, self.first[ids], self.n_bytes[ids])


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> ByteBpe:
    """One a Python worker, kept from task to task."""
    return ByteBpe(path, pattern)


def _steps(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of rows of about STEP_BYTES, a longer row alone."""
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + STEP_BYTES, "right")))
        yield at, to
        at = to


def _lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values, kind))


def encode_documents(docs: DataFrame, ranks: str, pattern: str = PATTERN, offsets: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array of int), n_split (ids that start or end inside a character), and with ``offsets`` starts and ends: the
    characters that each id covers, whole ones, so that neighbours share a character that they split. One map over the rows, no shuffle.

    Null texts are empty: no ids. Rows with null or equal keys stay rows of their own, equal texts have equal ids; special strings in
    texts are ordinary text. Other columns, whatever their names, are not read. An empty table gives an empty one. A very
    long text is one step of its own: what a task holds grows with its longest text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "").cast(pa.large_string())
            for at, to in _steps(pc.binary_length(texts).to_numpy()):
                some = texts[at:to]
                ids, lengths = own.encode(some.to_pylist())
                raw = np.frombuffer("".join(some.to_pylist()).encode(), np.uint8)
                first, last, split = own.spans(raw, ids)
                before = np.concatenate([[0], np.cumsum(lengths)])
                n_split = np.diff(np.concatenate([[0], np.cumsum(split)])[before])
                out = {"doc_id": batch.column(0)[at:to], "ids": _lists(ids, lengths, pa.int32()), "n_split": pa.array(n_split, pa.int64())}
                if offsets:
                    chars = pc.utf8_length(some).to_numpy()
                    base = np.repeat(np.cumsum(chars) - chars, lengths)
                    out |= {"starts": _lists(first - base, lengths, pa.int32()), "ends": _lists(last - base, lengths, pa.int32())}
                yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, ids array<int>, n_split long" + (", starts array<int>, ends array<int>" if offsets else "")
    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, ranks: str, pattern: str = PATTERN, ids: str = "ids") -> DataFrame:
    """The rows with ``ids`` replaced by decoded (binary), text (string), n_head and n_tail.

    ``decoded`` are the ids' bytes, so that those of windows of one document, put together, are the document's. ``text`` shows them as
    characters, each maximal part of a character that is not whole as one U+FFFD; n_head and n_tail are the bytes at either end that
    belong to characters which the list of ids cuts. Null lists are empty lists; an id outside the vocabulary is an error. Columns with the
    names of the new ones are replaced."""
    rest = [x for x in encoded.columns if x not in (ids, "decoded", "text", "n_head", "n_tail")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        for batch in batches:
            lists = batch.column(len(rest))
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            for at, to in _steps(lengths * 4):
                some = lengths[at:to]
                flat = lists[at:to].flatten().to_numpy(zero_copy_only=False)
                raw = own.decode(flat.astype(np.int64)).tobytes()
                cut = np.concatenate([[0], np.cumsum(own.n_bytes[flat])])[np.concatenate([[0], np.cumsum(some)])]
                parts = [raw[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                torn = [torn_ends(p) for p in parts]
                made = {
                    "decoded": pa.array(parts, pa.binary()), "text": pa.array([p.decode("utf-8", "replace") for p in parts], pa.string()),
                    "n_head": pa.array([x[0] for x in torn], pa.int32()), "n_tail": pa.array([x[1] for x in torn], pa.int32()),
                }
                yield pa.RecordBatch.from_pydict({f"c{i}": batch.column(i)[at:to] for i in range(len(rest))} | made)

    types = {f.name: f.dataType.simpleString() for f in encoded.schema.fields}
    schema = ", ".join([f"c{i} {types[x]}" for i, x in enumerate(rest)] + ["decoded binary", "text string", "n_head int", "n_tail int"])
    got = encoded.select(*(F.col(f"`{x}`") for x in rest), F.col(f"`{ids}`")).mapInArrow(run, schema)
    return got.withColumnsRenamed({f"c{i}": x for i, x in enumerate(rest)})


def torn_ends(raw: bytes) -> tuple[int, int]:
    """Bytes at the start that continue a character, and bytes at the end that begin one without ending it."""
    head = next((i for i, b in enumerate(raw[:4]) if b & 0xC0 != 0x80), len(raw[:4]))
    for back in range(1, min(4, len(raw) - head) + 1):
        b = raw[-back]
        if b & 0xC0 != 0x80:
            need = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
            return head, back if need > back else 0
    return head, 0


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again; the digests are Spark's, of the ids written in decimal and of the bytes."""
    import public_tokenizers

    from .common import table

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = encode_documents(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    named = encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), "n_split", "ids",
    )
    back = decode_documents(named, ranks, public_tokenizers.PATTERN)
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"), "n_split")


__all__ = ["ByteBpe", "decode_documents", "encode_documents", "op13_byte_bpe"]
