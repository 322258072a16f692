"""Token counts by rank-synchronous array merging.

Pre-tokens that are not in the cache are held as one ragged array of symbols. In
each round every sequence finds its lowest-ranked adjacent pair and merges all its occurrences,
all sequences at once; what is left when no pair has a rank are the tokens.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed value: the public byte-level pre-token pattern
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class RankMerger:
    """Counts tokens of a byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str, max_cached: int = 400_000):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only byte-level BPE files with the standard pre-token pattern")
        vocab = model["vocab"]
        self.base = np.array([vocab[c] for c in byte_letters()], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made_by_rank = key[order], order.astype(np.int64), made
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.find = regex.compile(PATTERN).findall
        self.cache: dict[str, int] = {}
        self.max_cached = max_cached

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], NONE)

    def merge(self, tokens: list[str]) -> np.ndarray:
        """Surviving symbols of each non-empty pre-token."""
        raw = [t.encode() for t in tokens]
        lengths = np.array([len(r) for r in raw])
        symbols = self.base[np.frombuffer(b"".join(raw), np.uint8)]
        owner = np.repeat(np.arange(len(raw)), lengths)
        counts = np.zeros(len(raw), np.int64)
        while len(symbols):
            inside = owner[:-1] == owner[1:]
            rank = np.full(len(symbols), NONE)
            rank[:-1][inside] = self.ranks(symbols[:-1][inside], symbols[1:][inside])
            starts = np.flatnonzero(np.r_[True, ~inside])
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(symbols)])
            over = least == NONE
            counts[owner[starts[over]]] = sizes[over]
            chosen = (rank == np.repeat(least, sizes)) & (rank != NONE)
            # of overlapping occurrences (aaa) every other one, from the left
            places = np.arange(len(symbols))
            first = chosen & ~np.r_[False, chosen[:-1]]
            since = places - np.maximum.accumulate(np.where(first, places, 0))
            chosen &= since % 2 == 0
            symbols = symbols.copy()
            symbols[chosen] = self.made_by_rank[rank[chosen]]
            keep = ~np.r_[False, chosen[:-1]] & ~np.repeat(over, sizes)
            symbols, owner = symbols[keep], owner[keep]
        return counts

    def learn(self, new: list[str]) -> dict[str, int]:
        got: dict[str, int] = {}
        for k in range(0, len(new), 16384):
            part = new[k : k + 16384]
            got.update(zip(part, self.merge(part).tolist(), strict=True))
        return got

    def count(self, texts: list[str | None]) -> list[int]:
        out = []
        for k in range(0, len(texts), 256):
            split, extra = [], []
            for t in texts[k : k + 256]:
                parts = self.special.split(t or "") if self.special else [t or ""]
                extra.append(len(parts) - 1)
                split.append([x for p in parts for x in self.find(p)] if len(parts) > 1 else self.find(parts[0]))
            new = set().union(*split).difference(self.cache)
            if len(self.cache) + len(new) > self.max_cached:
                self.cache = {}
                new = set().union(*split)
            self.cache.update(self.learn(list(new)))
            get = self.cache.__getitem__
            out += [e + sum(map(get, s)) for s, e in zip(split, extra, strict=True)]
        return out


@lru_cache(maxsize=4)
def merger_of(path: str) -> RankMerger:
    """One merger a Python worker, kept from task to task."""
    return RankMerger(path)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of whole texts; one map over the rows, no shuffle.

    Null texts are empty (0 tokens); rows with equal or null keys stay rows of their own. Other columns, whatever their names, are not
    read; an empty table gives an empty one. Texts are counted 256 at a time, a very long one whole, as its pre-tokens."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        merger = merger_of(tokenizer)
        for pdf in batches:
            texts = [None if pd.isna(t) else t for t in pdf["t"]]
            n = merger.count(texts)
            out = {"doc_id": pdf["k"].astype("Int64"), "n_bytes": pdf["b"], "n_tokens": n, "over_limit": [x > limit for x in n]}
            yield pd.DataFrame(out)

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("b"))
    return rows.mapInPandas(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


__all__ = ["RankMerger", "op9_token_counts", "token_counts"]
