"""SentencePiece encoding and decoding by a max-plus scan.

A BPE segmentation is the only sequence of pieces in which every two neighbours are
compatible, that is, encode to themselves when put together: a merge across a border would be
the best merge of the two neighbours alone as well. So encoding is a best-path problem over places and
pieces with edge weights 0 (compatible) and minus infinity, and a path's weight after that is its
number of pieces. Its max-plus form is associative, which is what giant documents need:

1. a giant text is split into chunks of equal length, inside words or not;
2. each chunk yields its transfer matrix: from every piece that can cover its left border to every piece
   that can cover its right border, the pieces between (minus infinity: no path);
3. matrices are combined in groups of FAN neighbours, the groups' matrices again, and so on, and the states
   that the whole document's path passes are handed down the same tree: no task sees more than FAN matrices of a document;
4. each chunk, told its entry and exit states, traces its own pieces back.

Steps 2 and 4 are maps over chunks. Where no piece can cross (no piece holds the two characters in a row), every path
starts anew: there a chunk's matrix is a column, the pieces of the stretches between, and a row. Such
stretches repeat, and their paths are found once a batch for all new ones together. Smaller texts are made of them alone.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .word_tokens import Cache, ragged

#: Characters from which a text counts as giant, and how many a chunk of it has.
GIANT, CHUNK = 32_768, 8_192
#: Matrices that are combined at once, and how often: FAN**LEVELS chunks are more than a Spark string can hold.
FAN, LEVELS = 64, 3
#: Characters of text that are worked on at a time.
STEP = 3 << 20
SPACE = "▁"
START = -1
_PRIME = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SLOTS, _PAIRS = 18, 20
#: Characters below it have places of their own in the table of neighbours; the last two stand for the space mark and for all others.
_CHARS = 1024


class PieceScan:
    """Encoder for a BPE model file of the sentencepiece library.

    Ids from ``size`` up stand for characters without a piece; they become bytes or the
    unknown id at the end."""

    def __init__(self, path: str, most: int = 220_000):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        plain = [i for i in range(self.size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.text = [sp.id_to_piece(i) for i in range(self.size)]
        self.ids = {self.text[i]: i for i in plain}
        self.score = {self.text[i]: sp.get_score(i) for i in plain}
        self.longest = max(map(len, self.ids))
        self.lengths = np.array([*map(len, self.text)], np.int64)
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_fallback = sp.is_byte(self.bytes[0])
        self.memo: dict[tuple[int, int], bool] = {}
        # codes of pairs that were asked for, with the answer in the lowest bit
        self.pairs = np.full(1 << _PAIRS, -1, np.int64)
        self.cache = Cache(most, self._learn)
        self._tables(plain)

    def _tables(self, plain: list[int]) -> None:
        """By piece: hash, place in the order of merging (-1: a single character), the two parts of its last
        merge, whether it encodes to itself; a hash table of pieces; which neighbours a piece can hold."""
        size, single = self.size, {i for i in plain if len(self.text[i]) == 1}
        self.hashes, self.rank = np.zeros(size, np.uint64), np.full(size, -1, np.int64)
        self.left, self.right, self.sound = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, bool)
        order = {x: k for k, x in enumerate(sorted(set(self.score.values()), reverse=True))}
        self.power = np.array([pow(int(_PRIME), k, 1 << 64) for k in range(self.longest + 1)], np.uint64)
        self.slots, self.slot_ids = np.zeros(1 << _SLOTS, np.uint64), np.full(1 << _SLOTS, -1, np.int64)
        cross = np.zeros((_CHARS, _CHARS), bool)
        cross[_CHARS - 1, :] = cross[:, _CHARS - 1] = True
        for i in plain:
            s = self.text[i]
            codes = np.array([*map(ord, s)], np.uint32)
            self.hashes[i] = self._prefixes(codes[None, :])[0, -1]
            classes = self._classes(codes)
            cross[classes[:-1], classes[1:]] = True
            steps = self.merged(s, last_two=True)
            self.sound[i] = i in single or len(steps) == 2
            if i not in single and self.sound[i]:
                self.rank[i] = order[self.score[s]]
                self.left[i], self.right[i] = (self.ids.get(x, size + ord(x[0])) for x in steps)
            at = (int(self.hashes[i]) * int(_MIX) & (1 << 64) - 1) >> 64 - _SLOTS
            while self.slot_ids[at] >= 0:
                at = (at + 1) % (1 << _SLOTS)
            self.slots[at], self.slot_ids[at] = self.hashes[i], i
        self.apart = ~cross.ravel()

    @staticmethod
    def _classes(codes: np.ndarray) -> np.ndarray:
        out = np.minimum(codes, _CHARS - 1).astype(np.int32)
        out[codes == _CHARS - 2] = _CHARS - 1
        out[codes == ord(SPACE)] = _CHARS - 2
        return out

    @staticmethod
    def _prefixes(chars: np.ndarray) -> np.ndarray:
        """Polynomial hashes of the prefixes of each row, the empty one first."""
        out = np.zeros((len(chars), chars.shape[1] + 1), np.uint64)
        for j in range(chars.shape[1]):
            out[:, j + 1] = out[:, j] * _PRIME + chars[:, j].astype(np.uint64) + np.uint64(1)
        return out

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids of pieces by hash, -1 for none."""
        at = (h * _MIX >> np.uint64(64 - _SLOTS)).astype(np.int64)
        ids, same = self.slot_ids[at], self.slots[at] == h
        out = np.where(same, ids, -1)
        left = np.flatnonzero(~same & (ids >= 0))
        while len(left):
            at[left] = (at[left] + 1) % (1 << _SLOTS)
            ids, same = self.slot_ids[at[left]], self.slots[at[left]] == h[left]
            out[left[same]] = ids[same]
            left = left[~same & (ids >= 0)]
        return out

    def merged(self, s: str, last_two: bool = False) -> list[str]:
        """The library's merging of a short string: the best-scored pair, the leftmost of equals. ``last_two``:
        the two parts before the last merge, if there is one."""
        parts, get = [*s], self.score.get
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                x = get(parts[i] + parts[i + 1])
                if x is not None and (best is None or x > best):
                    best, at = x, i
            if best is None:
                return [] if last_two else parts
            if last_two and len(parts) == 2:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def piece(self, i: int) -> str:
        return self.text[i] if i < self.size else chr(i - self.size)

    def compatible(self, a: int, b: int) -> bool:
        """Whether piece b can follow piece a (START: begin a text)."""
        got = self.memo.get((a, b))
        if got is None:
            if len(self.memo) >= 200_000:
                self.memo.clear()
            pair = [self.piece(b)] if a == START else [self.piece(a), self.piece(b)]
            got = self.memo[a, b] = self.merged("".join(pair)) == pair
        return got

    def _of(self, values: np.ndarray, ids: np.ndarray, other) -> np.ndarray:
        return np.where(ids < self.size, values[np.minimum(ids, self.size - 1)], other)

    def compatible_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """compatible() for arrays, START not among them: the two pieces' merges are undone from the last one on; if what then
        meets at the border merges before the merge undone, it would have merged across."""
        good = self._of(self.sound, a, True) & self._of(self.sound, b, True)
        live = np.flatnonzero(good)
        a, b = a[live], b[live]
        limit = np.full(len(live), np.iinfo(np.int64).max)
        while len(live):
            length = self._of(self.lengths, b, 1)
            short = (self._of(self.lengths, a, 1) + length) <= self.longest
            h = self._of(self.hashes, a, (a - self.size + 1).astype(np.uint64)) * self.power[length] + self._of(self.hashes, b, (b - self.size + 1).astype(np.uint64))
            both = np.where(short, self.find(h), -1)
            bad = (both >= 0) & (np.where(both >= 0, self._order(both), 0) < limit)
            good[live[bad]] = False
            ra, rb = self._of(self.rank, a, -1), self._of(self.rank, b, -1)
            go = ~bad & (np.maximum(ra, rb) >= 0)
            live, a, b, ra, rb = live[go], a[go], b[go], ra[go], rb[go]
            first = ra > rb
            limit = np.where(first, ra, rb + 1)
            a, b = np.where(first, self.right[np.minimum(a, self.size - 1)], a), np.where(first, b, self.left[np.minimum(b, self.size - 1)])
        return good

    def _compatible_known(self, pairs: np.ndarray) -> np.ndarray:
        """compatible_pairs() of codes (first << 22 | second), looked up in a table where a pair has one place, which the last one holds."""
        at = ((pairs.view(np.uint64) * _MIX) >> np.uint64(64 - _PAIRS)).astype(np.int64)
        held = self.pairs[at]
        ok = (held & 1).astype(bool)
        missing = np.flatnonzero(held >> 1 != pairs)
        if len(missing):
            new, first, back = np.unique(pairs[missing], return_index=True, return_inverse=True)
            got = self.compatible_pairs(new >> 22, new & (1 << 22) - 1)
            self.pairs[at[missing[first]]] = new << 1 | got
            ok[missing] = got[back]
        return ok

    def _order(self, ids: np.ndarray) -> np.ndarray:
        return np.where(self.sound[ids], self.rank[ids], np.iinfo(np.int64).max)

    def at(self, s: str, a: int, b: int) -> int | None:
        """Id of the piece s[a:b], if it is one."""
        got = self.ids.get(s[a:b])
        return self.size + ord(s[a]) if got is None and b == a + 1 else got

    def forward(self, s: str, entry: int, at: int, known: list | None = None) -> list:
        """last[j]: the last piece of the only compatible path that comes from piece ``entry``, ending at ``at``, to j.

        ``known`` holds results of other entries; where the last ``longest`` places agree with one, the
        rest is the same and is taken from it."""
        n, longest = len(s), self.longest
        last: list = [None] * (n + 1)
        last[at] = entry
        for j in range(at + 1, n + 1):
            for a in range(j - 1, max(at, j - longest) - 1, -1):
                before = last[a]
                if before is not None and (i := self.at(s, a, j)) is not None and self.compatible(before, i):
                    last[j] = i
                    break
            if known and j % 8 == 0 and j - at >= longest:
                for other in known:
                    if other[j - longest + 1 : j + 1] == last[j - longest + 1 : j + 1]:
                        last[j + 1 :] = other[j + 1 :]
                        return last
        return last

    def trace(self, last: list, at: int, end: int) -> list[int]:
        """Pieces from ``at`` to ``end``, backwards along ``last``."""
        out, lengths, size = [], self.lengths, self.size
        while end > at:
            i = last[end]
            out.append(i)
            end -= int(lengths[i]) if i < size else 1
        out.reverse()
        return out

    # stretches between places where no piece can cross

    def _learn(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Paths of stretches (UTF-32), all of a length at once; few or very long ones singly."""
        size = np.fromiter(map(len, new), np.int64, len(new)) >> 2
        ids: list[np.ndarray] = []
        lengths, order = np.zeros(len(new), np.int64), []
        for n in np.unique(size).tolist():
            rows = np.flatnonzero(size == n)
            some = [new[i] for i in rows.tolist()]
            if len(rows) < 8 or n > 64:
                got = [self.trace(self.forward(s, START, 0), 0, n) for s in (x.decode("utf-32-le") for x in some)]
                parts = [(np.array([i for g in got for i in g], np.int64), np.array([*map(len, got)], np.int64))]
            else:
                parts = [self._paths(np.frombuffer(b"".join(some[k : k + 8192]), "<u4").reshape(-1, n)) for k in range(0, len(some), 8192)]
            ids += [p for p, _ in parts]
            lengths[rows] = np.concatenate([m for _, m in parts])
            order.append(rows)
        at = np.concatenate(order)
        flat, lengths[at] = self._final(np.concatenate(ids), lengths[at])
        starts = np.zeros(len(new), np.int64)
        starts[at] = np.cumsum(lengths[at]) - lengths[at]
        return ragged(flat, starts, lengths), lengths

    def _paths(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of every row in a row, and the rows' numbers of them."""
        count, n = chars.shape
        prefix, longest = self._prefixes(chars), min(n, self.longest)
        pieces = [self.find((prefix[:, k:] - prefix[:, :-k] * self.power[k]).ravel()).reshape(count, -1) for k in range(1, longest + 1)]
        pieces[0] = np.where(pieces[0] < 0, self.size + chars.astype(np.int64), pieces[0])
        last = np.full((count, n + 1), -2, np.int64)
        last[:, 0] = START
        for j in range(1, n + 1):
            for k in range(min(j, longest), 0, -1):
                a = j - k
                rows = np.flatnonzero((pieces[k - 1][:, a] >= 0) & (last[:, a] != -2) & (last[:, j] == -2))
                if not len(rows):
                    continue
                here = pieces[k - 1][rows, a]
                if not a:
                    ok = self._of(self.sound, here, True)
                else:
                    ok = self._compatible_known(last[rows, a] << 22 | here)
                last[rows[ok], j] = here[ok]
        out = np.full((count, n), -2, np.int64)
        to, every = np.full(count, n), np.arange(count)
        for k in range(n - 1, -1, -1):
            live = every[to > 0]
            if not len(live):
                break
            i = last[live, to[live]]
            out[live, k] = i
            to[live] -= self._of(self.lengths, i, 1)
        return out[out != -2], (out != -2).sum(axis=1)

    def _final(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece as bytes or unknown; ids in a row and their numbers."""
        odd = np.flatnonzero(ids >= self.size)
        if not len(odd):
            return ids.astype(np.uint32), lengths
        of = np.repeat(np.arange(len(lengths)), lengths)
        long = np.ones(len(ids), np.int64)
        long[odd] = [len(chr(i).encode()) if self.byte_fallback else 1 for i in (ids[odd] - self.size).tolist()]
        out = np.repeat(np.where(ids < self.size, ids, 0), long)
        places = np.cumsum(long) - long
        for k, i in zip(places[odd].tolist(), (ids[odd] - self.size).tolist(), strict=True):
            raw = [self.bytes[b] for b in chr(i).encode()] if self.byte_fallback else [self.sp.unk_id()]
            out[k : k + len(raw)] = raw
        return out.astype(np.uint32), np.bincount(of, long, len(lengths)).astype(np.int64)

    def borders(self, codes: np.ndarray) -> np.ndarray:
        """Whether no piece can cross from each character to the next one."""
        classes = self._classes(codes)
        return self.apart[classes[:-1] * _CHARS + classes[1:]]

    def encode_normalized(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts in the library's normal form, in a row, and each text's number of them."""
        import pyarrow as pa

        raw = "".join(texts).encode("utf-32-le")
        codes = np.frombuffer(raw, "<u4")
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        if not len(codes):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        cut = np.zeros(len(codes) + 1, bool)
        cut[1:-1] = self.borders(codes)
        cut[0] = cut[-1] = True
        cut[ends] = True
        places = np.flatnonzero(cut)
        stretches = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer((4 * places).astype(np.int64)), pa.py_buffer(raw)])
        numbered = stretches.dictionary_encode()
        numbers = self.cache.numbers(numbered.dictionary.to_numpy(zero_copy_only=False).tolist())[numbered.indices.to_numpy()]
        ids, lengths = self.cache.young.ids(numbers)
        before = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(lengths, out=before[1:])
        return ids, np.diff(before[np.searchsorted(places, ends)], prepend=0)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of texts, a few megabytes at a time."""
        out, k = [], 0
        while k < len(texts):
            to, size = k, 0
            while to < len(texts) and (to == k or size + len(texts[to]) <= STEP):
                size += len(texts[to])
                to += 1
            ids, lengths = self.encode_normalized([self.sp.normalize(t) for t in texts[k:to]])
            raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(lengths)).tolist()
            out += [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            k = to
        return out

    def final(self, ids: list[int]) -> bytes:
        """Little-endian unsigned 32-bit ids, characters without a piece as bytes or unknown."""
        flat, _ = self._final(np.array(ids, np.int64), np.array([len(ids)]))
        return array("I", flat.tolist()).tobytes()

    # chunks of giant texts

    def states(self, around: str, border: int) -> list[tuple[int, int]]:
        """Pieces over or up to a border inside ``around``: (id, places its end is behind the border).

        Where no piece can cross, only that a path ends there counts, whatever its last piece: START."""
        if border == 0 or border == len(around) or self.borders(np.array([*map(ord, around[border - 1 : border + 1])], np.uint32))[0]:
            return [(START, 0)]
        out = []
        for a in range(max(0, border - self.longest), border):
            for b in range(border, min(len(around), a + self.longest) + 1):
                i = self.at(around, a, b)
                if i is not None and self.compatible(START, i):
                    out.append((i, b - border))
        return out

    def cut(self, s: str, n: int) -> tuple[int, int]:
        """The first and last place of s[:n] behind its start where no piece can cross (-1: none)."""
        if n == 0:
            return -1, -1
        free = np.flatnonzero(self.borders(np.array([*map(ord, s)], np.uint32))) + 1
        free = free[free <= n].tolist()
        if len(s) == n:
            free.append(n)
        return (free[0], free[-1]) if free else (-1, -1)

    def ends_at(self, last: list, at: int, exits: list[tuple[int, int]], n: int, entry: int) -> list[list[int] | None]:
        """Pieces behind place ``at`` on the path to each exit of a border at ``n``; None: it does not lead there."""
        out = []
        for i, over in exits:
            end = n + over
            got = last[end] if end < len(last) else None
            if got is None or (i != START and got != i):
                out.append(None)
            elif end == at:
                out.append([] if i in (START, entry) else None)
            else:
                out.append(self.trace(last, at, end) if end - len(self.piece(got)) >= at else None)
        return out


class Spelling:
    """The bytes of every piece: from byte pieces as they are, the space mark as a space."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        spelled = [sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(sp.get_piece_size())]
        for b in range(256):
            if sp.is_byte(i := sp.piece_to_id(f"<0x{b:02X}>")):
                spelled[i] = bytes([b])
        self.flat = np.frombuffer(b"".join(spelled), np.uint8)
        self.length = np.array([*map(len, spelled)], np.int64)
        self.start = np.cumsum(self.length) - self.length

    def decode(self, raws: list[bytes]) -> list[str]:
        """Texts of ids (little-endian unsigned 32-bit); the prefix space goes."""
        out, k = [], 0
        while k < len(raws):
            to, size = k, 0
            while to < len(raws) and (to == k or size + len(raws[to]) <= STEP):
                size += len(raws[to])
                to += 1
            ids = np.frombuffer(b"".join(raws[k:to]), "<u4")
            ends = np.zeros(len(ids) + 1, np.int64)
            np.cumsum(self.length[ids], out=ends[1:])
            blob = ragged(self.flat, self.start[ids], self.length[ids]).tobytes()
            cut = ends[np.cumsum([len(r) // 4 for r in raws[k:to]])].tolist()
            out += [blob[a:b].decode("utf-8", "replace").removeprefix(" ") for a, b in zip([0, *cut], cut, strict=False)]
            k = to
        return out


@lru_cache(maxsize=4)
def spelling_of(path: str) -> Spelling:
    return Spelling(path)


@lru_cache(maxsize=4)
def scan_of(path: str) -> PieceScan:
    """One scan a Python worker, kept from task to task."""
    return PieceScan(path)


def _chunks(model: str, size: int):
    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        scan = scan_of(model)
        for pdf in batches:
            for rid, t in zip(pdf["rid"], pdf["t"], strict=True):
                s = scan.sp.normalize(t)
                cuts = [*range(0, max(1, len(s) - scan.longest), size), len(s)]
                rows = [(rid, k, s[max(0, a - scan.longest) : a], s[a:b], s[b : b + scan.longest]) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
                for k in range(0, len(rows), 256):
                    yield pd.DataFrame(rows[k : k + 256], columns=["rid", "k", "before", "body", "after"])

    return run


class _Chunk:
    """A chunk with its states and the parts that its paths have: a head for each entry, stretches, a tail for each exit."""

    def __init__(self, scan: PieceScan, before: str, body: str, after: str):
        self.scan, self.s, self.n = scan, body + after, len(body)
        whole, a = before + self.s, len(before)
        self.entries, self.exits = scan.states(whole, a), scan.states(whole, a + self.n)
        self.first, self.last = scan.cut(self.s, self.n)
        if self.entries == [(START, 0)]:
            self.first = 0
            self.last = max(self.last, 0)
        self.middle = self.s[self.first : self.last] if self.first >= 0 else ""

    def heads(self) -> list[list[int] | None]:
        """Of each entry the pieces up to the first free place."""
        out = []
        for i, at in self.entries:
            last = self.scan.forward(self.s[: self.first], i, at) if at <= self.first else None
            out.append(None if last is None or last[self.first] is None else self.scan.trace(last, at, self.first))
        return out

    def tails(self) -> list[list[int] | None]:
        """Of each exit the pieces from the last free place."""
        last = self.scan.forward(self.s[self.last :], START, 0)
        return self.scan.ends_at(last, 0, self.exits, self.n - self.last, START)

    def through(self) -> list[list[list[int] | None]]:
        """Without a free place: the pieces from each entry to each exit."""
        out, known = [], []
        for i, at in self.entries:
            last = self.scan.forward(self.s, i, at, known)
            out.append(self.scan.ends_at(last, at, self.exits, self.n, i))
            known.append(last)
        return out

    def matrix(self, between: int) -> np.ndarray:
        weigh = lambda parts: np.array([-np.inf if p is None else len(p) for p in parts])
        if self.first < 0:
            return np.stack([weigh(row) for row in self.through()])
        return weigh(self.heads())[:, None] + between + weigh(self.tails())[None, :]

    def ids(self, entry: int, exit_: int, between: bytes) -> bytes:
        if self.first < 0:
            return self.scan.final(self.through()[entry][exit_])
        return self.scan.final(self.heads()[entry]) + between + self.scan.final(self.tails()[exit_])


def _batch_chunks(scan: PieceScan, pdf) -> Iterator[tuple]:
    """Chunks of a batch, each with its row and its stretches' ids; those of some chunks are looked up together."""
    for k in range(0, len(pdf), 256):
        part = pdf.iloc[k : k + 256]
        chunks = [_Chunk(scan, *x) for x in zip(part["before"], part["body"], part["after"], strict=True)]
        ids, lengths = scan.encode_normalized([c.middle for c in chunks])
        yield from zip(part.itertuples(), chunks, np.split(ids, np.cumsum(lengths)[:-1]), strict=True)


def _matrices(model: str):
    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        scan = scan_of(model)
        for pdf in batches:
            made = [(row.rid, row.k, chunk.matrix(len(ids))) for row, chunk, ids in _batch_chunks(scan, pdf)]
            yield pd.DataFrame([(r, k, m.shape[1], m.ravel().tolist()) for r, k, m in made], columns=["rid", "k", "width", "cells"])

    return run


def _unpacked(pdf) -> list[np.ndarray]:
    return [np.array(c).reshape(-1, w) for c, w in zip(pdf["cells"], pdf["width"], strict=True)]


def _product(pdf):
    """The max-plus product of up to FAN neighbouring matrices of one document."""
    import pandas as pd

    pdf = pdf.sort_values("k")
    first, *rest = _unpacked(pdf)
    for m in rest:
        first = (first[:, :, None] + m[None, :, :]).max(axis=1)
    return pd.DataFrame({"rid": pdf["rid"].iloc[:1], "k": pdf["up"].iloc[:1], "width": [first.shape[1]], "cells": [first.ravel().tolist()]})


def _handed_down(pdf):
    """Entry and exit state of each of up to FAN neighbours, given those of them together: products from the left, then the
    only finite path back from the right."""
    pdf = pdf.sort_values("k")
    mats = _unpacked(pdf)
    reach = [np.full(len(mats[0]), -np.inf)]
    reach[0][int(pdf["entry"].iloc[0])] = 0
    for m in mats:
        reach.append((reach[-1][:, None] + m).max(axis=0))
    path = [int(pdf["exit"].iloc[0])]
    for m, before in zip(mats[::-1], reach[-2::-1], strict=True):
        path.append(int((before + m[:, path[-1]]).argmax()))
    path = path[::-1]
    return pdf[["rid", "k"]].assign(entry=path[:-1], exit=path[1:])


def _told_states(mats: DataFrame, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """rid, k, entry, exit of every chunk: matrices are combined up a tree of fixed height, states handed down it."""
    up = lambda top: F.floor(F.col("k") / fan).cast("int") if not top else F.lit(0)
    # small rows, much work: an explicit number of partitions keeps Spark from putting them together by size
    parts = int(mats.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda df: df.repartition(parts, "rid", "up")
    tree = [mats]
    for level in range(1, levels):
        made = dealt(tree[-1].withColumn("up", up(False))).groupBy("rid", "up").applyInPandas(_product, "rid long, k int, width int, cells array<double>")
        tree.append(materialize(made, f"scan-level-{level}"))
    told = tree[-1].select("rid", F.lit(0).alias("up")).distinct().withColumns({"entry": F.lit(0), "exit": F.lit(0)})
    for level in reversed(range(levels)):
        below = tree[level].withColumn("up", up(level == levels - 1))
        told = dealt(below.join(told, ["rid", "up"])).groupBy("rid", "up").applyInPandas(_handed_down, "rid long, k int, entry int, exit int")
        told = told.withColumnRenamed("k", "up") if level else told
    return told


def _pieces(model: str):
    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        scan = scan_of(model)
        for pdf in batches:
            out = [(row.rid, row.k, chunk.ids(row.entry, row.exit, ids.astype("<u4").tobytes())) for row, chunk, ids in _batch_chunks(scan, pdf)]
            yield pd.DataFrame(out, columns=["rid", "k", "ids"])

    return run


IDS = "doc_id long, ids binary"
DECODED = "doc_id long, n_tokens long, ids_crc32 long, text string"


def encode_documents(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", giant: int = GIANT, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) for each row of ``docs``; as the library's encode().

    Null texts are empty and have no ids; repeated rows and keys stay rows of their own; an empty table gives none. Other columns
    of ``docs`` are never read, so their names cannot clash; texts may be as long as a Spark string."""
    small, large = _split(docs, key, text, giant)
    return small.mapInArrow(_encode(model), IDS).unionByName(_encode_large(large, model, chunk, fan))


def round_trip(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", giant: int = GIANT, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """decode_documents() of encode_documents(); one Python worker a task does both to smaller texts, so that no more than one is alive at a time."""
    small, large = _split(docs, key, text, giant)
    encode, decode = _encode(model), _decode(model)
    both = small.mapInArrow(lambda batches: decode(encode(batches)), DECODED)
    return both.unionByName(decode_documents(_encode_large(large, model, chunk, fan), model))


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, text of rows of :func:`encode_documents`; no rows give none."""
    return encoded.mapInArrow(_decode(model), DECODED)


def _split(docs: DataFrame, key: str, text: str, giant: int) -> tuple[DataFrame, DataFrame]:
    """rid, doc_id, t of the texts below ``giant`` characters, and of the others."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    n = F.char_length("t")
    return rows.where(n < giant).select("doc_id", "t"), materialize(rows.where(n >= giant), "giant-texts")


def _encode_large(large: DataFrame, model: str, chunk: int, fan: int) -> DataFrame:
    parts = int(large.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = large.select("rid", "t").mapInPandas(_chunks(model, chunk), "rid long, k int, before string, body string, after string")
    chunks = materialize(cut.repartition(parts, "rid", "k"), "giant-chunks")
    mats = materialize(chunks.mapInPandas(_matrices(model), "rid long, k int, width int, cells array<double>"), "scan-level-0")
    told = chunks.join(_told_states(mats, fan), ["rid", "k"])
    pieces = told.mapInPandas(_pieces(model), "rid long, k int, ids binary")
    # a document is a row in any case, so its parts may meet in one
    whole = pieces.groupBy("rid").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"]).alias("parts"))
    joined = whole.select("rid", F.aggregate("parts", F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids"))
    return large.select("rid", "doc_id").join(joined, "rid").select("doc_id", "ids")


def _encode(model: str):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scan = scan_of(model)
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                ids = scan.encode(part.column("t").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return run


def _decode(model: str):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        spelling = spelling_of(model)
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                raw = part.column("ids").to_pylist()
                columns = [part.column("doc_id"), pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array(spelling.decode(raw), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_crc32", "text"])

    return run


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (unsigned, little-endian unsigned 32-bit ids), decoded_chars, decoded_sha256 (UTF-8):
    every whole text of documents encoded, and decoded from those ids."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    got = round_trip(table(spark, sf_dir, "documents"), model)
    return got.select("doc_id", "n_tokens", "ids_crc32", F.char_length("text").cast("long").alias("decoded_chars"), F.sha2("text", 256).alias("decoded_sha256"))
