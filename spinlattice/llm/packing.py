"""Order-preserving packing of token streams into fixed-size sequences.

Documents stay in key order. Windows of at most ``size`` ids are cut by dynamic
programming: the cost of a window is its padding plus a penalty for where it ends (none at a
document's end, little at a sentence's end, more elsewhere). With val[j] the least cost
of all cuts up to place j plus j itself, val[j] = size + penalty[j] + min val[i] over the window
of places i within ``size`` before j, which a monotone queue keeps at constant cost.

Places are document ends, sentence ends and, so that there is one in reach, every STRIDE-th id of a partition's stream; among
these the cutting of a partition is the cheapest, whatever its length: windows are given out only up to the last place that the
cheapest cuttings of all places still in reach have in common, since whatever follows cannot change what is before it.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE = 4096
#: In padding ids: what a cut inside a document costs at a sentence's end, and elsewhere.
SENTENCE, INSIDE = 4, 48
#: Between sentence ends there is a place to cut at least every so many ids.
STRIDE = 64

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Cutting:
    """The dynamic programme over a growing list of places (ascending, the first one given, gaps of ``size`` at most): for each the least
    cost of windows up to it (val) and the number of the place where the last of these begins (back)."""

    def __init__(self, size: int, first: int = 0):
        self.size, self.places, self.val, self.back, self.queue = size, [first], [0], [0], deque([0])

    def extend(self, places: list[int], penalty: list[int]) -> None:
        have, val, back, queue, size = self.places, self.val, self.back, self.queue, self.size
        for at, cost in zip(places, penalty, strict=True):
            while have[queue[0]] < at - size:
                queue.popleft()
            i = queue[0]
            v = val[i] + size + cost
            while queue and val[queue[-1]] > v:
                queue.pop()
            queue.append(len(have))
            have.append(at)
            val.append(v)
            back.append(i)

    def _chain(self, j: int) -> list[int]:
        cuts = []
        while j:
            cuts.append(j)
            j = self.back[j]
        return cuts[::-1]

    def whole(self) -> list[int]:
        """Numbers of the places where the windows of a cheapest cutting end; the last is always the last place. The last window's
        padding is free: it is cut to powers of two."""
        last = len(self.places) - 1
        if not last:
            return []
        low = last - 1
        while low and self.places[low - 1] >= self.places[last] - self.size:
            low -= 1
        begin = min(range(low, last), key=lambda i: self.val[i] - self.places[i])
        return [*self._chain(begin), last]

    def settled(self) -> list[int]:
        """Those windows' ends that belong to the cheapest cutting whatever places follow: up to the last one that is on the
        ways to all places within ``size`` of the end, from one of which the next window begins."""
        j, end = len(self.places) - 1, self.places[-1]
        far = []
        while j >= 0 and self.places[j] > end - self.size:
            far.append(-j)
            j -= 1
        heapify(far)
        while True:  # the furthest place goes a window back until all are one
            j = -heappop(far)
            while far and far[0] == -j:
                heappop(far)
            if not far:
                return self._chain(j)
            heappush(far, -self.back[j])

    def forget(self, j: int) -> None:
        """Begin at place ``j``, on which all ways meet."""
        self.places, self.val = self.places[j:], self.val[j:]
        self.back = [max(i - j, 0) for i in self.back[j:]]
        self.queue = deque(i - j for i in self.queue if i >= j)


def _places(stream: np.ndarray, doc_ends: np.ndarray, ends_sentence: np.ndarray, before: int = 0) -> tuple[list, list]:
    """Places in ``stream``, which has ``before`` ids before it, and what a cut there costs."""
    n = len(stream)
    sentence = np.flatnonzero(ends_sentence[np.minimum(stream, len(ends_sentence) - 1)]) + 1
    marked = np.zeros(n + 1, bool)
    marked[-before % STRIDE :: STRIDE] = True
    marked[0] = marked[sentence] = marked[doc_ends] = marked[n] = True
    places = np.flatnonzero(marked)
    cost = np.full(len(places), INSIDE)
    cost[np.searchsorted(places, sentence)] = SENTENCE
    cost[np.searchsorted(places, doc_ends)] = 0
    return places.tolist(), cost.tolist()


class Packer:
    """Packs one partition's documents as they come. It goes on with the programme and looks for settled windows whenever ``look``
    windows of ids have come, which changes what it holds at a time and never the cutting."""

    def __init__(self, ends_sentence: np.ndarray, size: int = SIZE, first_sequence: int = 0, look: int = 96):
        self.ends_sentence, self.size, self.look, self.sequence = ends_sentence, size, look * size, first_sequence
        self.docs: deque[tuple] = deque()  # key, ids, where it starts in the stream
        self.cutting, self.at = Cutting(size), 0  # at: where the next window begins
        self.end = self.known = 0  # of the stream, and of what the programme has seen
        self.fresh: list[np.ndarray] = []

    def add(self, key, ids: np.ndarray) -> list[tuple]:
        self.docs.append((key, ids, self.end))
        self.fresh.append(ids)
        self.end += len(ids)
        return self.flush(False) if self.end - self.known >= self.look else []

    def flush(self, last: bool) -> list[tuple]:
        """The pieces of what is settled, at ``last`` of all that is held."""
        if self.fresh:
            places, cost = _places(np.concatenate(self.fresh), np.cumsum([len(x) for x in self.fresh]), self.ends_sentence, self.known)
            self.cutting.extend([self.known + p for p in places[1:]], cost[1:])
            self.fresh, self.known = [], self.end
        numbers = self.cutting.whole() if last else self.cutting.settled()
        if not numbers:
            return []
        cuts = [self.cutting.places[j] for j in numbers]
        if last:
            # a sequence whose length is a power of two takes no padding: the rest becomes such lengths
            a, b = cuts[-2] if len(cuts) > 1 else self.at, cuts.pop()
            while a < b:
                a += 1 << ((b - a).bit_length() - 1)
                cuts.append(a)
        else:
            self.cutting.forget(numbers[-1])
        out = []
        for b in cuts:
            at = self.at
            while at < b:
                key, ids, start = self.docs[0]
                to = min(b, start + len(ids))
                piece = ids[at - start : to - start]
                out.append((key, at - start, to - at, zlib.crc32(piece.tobytes()), len(ids), self.sequence, at - self.at))
                at = to
                if to == start + len(ids):
                    self.docs.popleft()
            self.sequence += 1
            self.at = b
        return out


@lru_cache(maxsize=4)
def sentence_ends(tokenizer_path: str) -> np.ndarray:
    """For every id, whether it is end-of-sentence punctuation; read once a Python worker."""
    import re

    from tokenizers import Tokenizer

    vocab = Tokenizer.from_file(tokenizer_path).get_vocab(with_added_tokens=True)
    flags = np.zeros(max(vocab.values()) + 2, bool)
    for piece, i in vocab.items():
        flags[i] = bool(re.fullmatch(r"""[.!?]+["')\]]*(</w>)?""", piece))
    return flags


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = SIZE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece of a document in a sequence.

    One range shuffle orders the documents, then each partition packs its own stream; only
    a partition's last ids can need sequences shorter than ``size``, cut to powers of two,
    which take no padding. Null texts are empty documents (the end id alone), null
    keys come first, repeated keys are documents of their own, no rows give no rows. Other columns, whatever their names, are not read. A very
    long text is held whole, as are the windows after the last settled one.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        from .word_tokens import encoder

        encode_all = encoder(tokenizer).encode
        packer = Packer(sentence_ends(tokenizer), size, TaskContext.get().partitionId() << 40)
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def frame(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

        for batch in batches:
            keys, done = batch.column("k").to_pylist(), 0
            for flat, lengths in encode_all(batch.column("t")):
                ends = np.cumsum(lengths)
                flat = np.insert(flat.astype("<u4"), ends, end_id)
                ends += np.arange(1, len(ends) + 1)
                rows: list = []
                for key_, a, b in zip(keys[done : done + len(ends)], [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    rows += packer.add(key_, flat[a:b])
                done += len(ends)
                if rows:
                    yield frame(rows)
        if rows := packer.flush(True):
            yield frame(rows)

    ordered = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).repartitionByRange(F.col("k").asc_nulls_first())
    return ordered.sortWithinPartitions(F.col("k").asc_nulls_first()).mapInArrow(run, SCHEMA)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
