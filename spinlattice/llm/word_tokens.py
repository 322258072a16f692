"""Whole-text encoding with the tokenizers library, each distinct word of a batch looked up once.

Texts come as Arrow arrays. Arrow cuts them at white space and numbers a batch's distinct words; a
word's ids come from a store or, if it is new, from the library; numpy then lays the ids of
all words of the batch out in text order. Python objects exist only for a batch's distinct words.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Set before the library is imported in a task: its own threads would compete with Spark's.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bytes of UTF-8 up to U+023F: such characters are their own NFC forms and lower-case one by one.
_OWN_FORMS = bytes(range(0xC9))
#: White space to the library that is none to ASCII, as far as _OWN_FORMS reaches.
_INNER_SPACE = (b"\x1c", b"\x1d", b"\x1e", b"\x1f", b"\xc2\x85", b"\xc2\xa0")

# the byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on; spaces separate
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LEVEL = np.arange(256, dtype="<u4")
_BYTE_LEVEL[[b for b in range(256) if b not in _PRINTED]] = 256 + np.arange(256 - len(_PRINTED))
_BYTE_LEVEL[32] = 32

#: The end-of-document id that the packing and binary outputs append.
END_ID = 2
#: Bytes of text that are worked on at a time.
STEP_BYTES = 2 << 20


def splits_at_space(spec: dict) -> bool:
    """Whether white space always separates tokens and is dropped, so that a text's ids
    are its words' ids in a row: the first pre-tokenizer keeps only pattern matches, and
    the pattern has no white space in it."""
    pre = spec.get("pre_tokenizer") or {}
    first = pre["pretokenizers"][0] if pre.get("type") == "Sequence" else pre
    pattern = (first.get("pattern") or {}).get("Regex", " ")
    added = "".join(t["content"] for t in spec.get("added_tokens", []))
    return (
        first.get("type") == "Split"
        and first.get("behavior") == "Removed"
        and bool(first.get("invert"))
        and " " not in pattern
        and r"\s" not in pattern.replace(r"[^\s", "")
        and not any(c.isspace() for c in added)
    )


def ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[starts[0] : starts[0] + lengths[0]], flat[starts[1] : ...], ... in a row."""
    ends = np.cumsum(lengths)
    if not len(ends):
        return flat[:0]
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])]


def _merged(first: np.ndarray, a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Ids and lengths of items in their order; ``a`` has those of the items where ``first`` is true, ``b`` the others'."""
    if first.all():
        return a
    order = np.empty(len(first), np.int64)
    order[first], order[~first] = np.arange(len(a[1])), len(a[1]) + np.arange(len(b[1]))
    lengths = np.concatenate([a[1], b[1]])
    starts = np.cumsum(lengths) - lengths
    return ragged(np.concatenate([a[0], b[0]]), starts[order], lengths[order]), lengths[order]


class IdStore:
    """Ids of byte strings: a dictionary to numbers, and by number a stretch of one flat array."""

    def __init__(self, ids: type = np.uint32):
        self.at: dict[bytes, int] = {}
        self.n = self.size = 0
        self.start, self.length, self.flat = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(4096, ids)

    @staticmethod
    def _grown(a: np.ndarray, n: int) -> np.ndarray:
        if n <= len(a):
            return a
        out = np.zeros(max(n, 3 * len(a) // 2), a.dtype)
        out[: len(a)] = a
        return out

    def find(self, keys: list[bytes]) -> np.ndarray:
        """Their numbers, -1 for unknown ones."""
        return np.fromiter(map(self.at.get, keys, repeat(-1)), np.int64, len(keys))

    def add(self, keys: list[bytes], flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Numbers of new keys, whose ids stand in ``flat`` in a row."""
        numbers, n, size = np.arange(self.n, self.n + len(keys)), self.n + len(keys), self.size + len(flat)
        self.start, self.length, self.flat = self._grown(self.start, n), self._grown(self.length, n), self._grown(self.flat, size)
        self.flat[self.size : size] = flat
        self.start[self.n : n], self.length[self.n : n] = self.size + np.cumsum(lengths) - lengths, lengths
        self.at.update(zip(keys, numbers.tolist(), strict=True))
        self.n, self.size = n, size
        return numbers

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Their ids in a row, and how many each has."""
        lengths = self.length[numbers].astype(np.int64)
        return ragged(self.flat, self.start[numbers], lengths), lengths


class Cache:
    """Two generations of at most ``most`` keys (or a batch's): a full young one becomes the old one, from which
    keys in use return. That bounds memory and changes speed, never results."""

    def __init__(self, most: int, learn: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], ids: type = np.uint32):
        self.most, self.learn, self.kind = most, learn, ids
        self.young, self.old = IdStore(ids), IdStore(ids)

    def numbers(self, keys: list[bytes]) -> np.ndarray:
        """Numbers in ``young`` of distinct keys; unknown ones are learned."""
        got = self.young.find(keys)
        missing = np.flatnonzero(got < 0)
        if self.young.n + len(missing) > self.most and self.young.n:
            self.old, self.young = self.young, IdStore(self.kind)
            got[:] = -1
            missing = np.arange(len(keys))
        if len(missing) and self.old.n:
            absent = [keys[i] for i in missing.tolist()]
            held = self.old.find(absent)
            back = np.flatnonzero(held >= 0)
            if len(back):
                got[missing[back]] = self.young.add([absent[i] for i in back.tolist()], *self.old.ids(held[back]))
                missing = missing[held < 0]
        if len(missing):
            new = [keys[i] for i in missing.tolist()]
            got[missing] = self.young.add(new, *self.learn(new))
        return got


class TextEncoder:
    """``encode(texts)`` gives the texts' ids in a row, and the number of each text's.

    Where white space separates tokens, a word's ids are looked up. A new word of Latin letters is
    lower-cased and cut by the file's own pattern, and the library encodes only pre-tokens
    not seen before; other new words go to the library whole, as do all texts where white space does not separate.
    """

    def __init__(self, path: str, max_words: int = 220_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = splits_at_space(spec)
        kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.words, self.pieces = Cache(max_words, self._learn_words, kind), Cache(max_words // 2, self._learn_pieces, kind)
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.cut, self.mark = None, b""
        if self.by_word and kinds == ["NFC", "Replace", "Lowercase"]:
            parts = spec["pre_tokenizer"]["pretokenizers"]
            self.cut = f"({parts[0]['pattern']['Regex']})"
            # the same model for pre-tokens with spaces between them, whose bytes are mapped here
            bare = spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
            self.bare = Tokenizer.from_str(json.dumps(bare))
            self.bare.model._resize_cache(0)  # it sees no pre-token twice
            if parts[1:] != [{"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]:
                self.cut = None
            suffix = spec["model"].get("end_of_word_suffix")
            vocab = spec["model"]["vocab"]
            self.last = np.zeros(max(vocab.values()) + 1, bool)
            if suffix:  # every pre-token's last id, and no other, carries the suffix
                self.last[[i for piece, i in vocab.items() if piece.endswith(suffix)]] = True
            special = [t["content"].encode() for t in spec.get("added_tokens", [])]
            self.mark = os.path.commonprefix(special) or b"\0"

    def _learn_pieces(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Pre-tokens through the library; their borders show in the ids."""
        full = np.flatnonzero(np.fromiter(map(len, new), np.int64, len(new)))
        mapped = _BYTE_LEVEL[np.frombuffer(b" ".join([new[i] for i in full.tolist()]), np.uint8)].tobytes().decode("utf-32-le")
        ids = np.array(self.bare.encode_batch_fast([mapped], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(full):
            raise ValueError("the tokenizer's model does not mark the ends of pre-tokens")
        lengths = np.zeros(len(new), np.int64)
        lengths[full] = np.diff(ends, prepend=0)
        return ids, lengths

    @staticmethod
    def _encode(tokenizer, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = tokenizer.encode(parts, is_pretokenized=True, add_special_tokens=False)
        return np.array(got.ids, np.uint32), np.bincount(np.array(got.word_ids, np.int64), minlength=len(parts))

    def _plain(self, blob: bytes) -> bool:
        return self.mark not in blob and not blob.translate(None, _OWN_FORMS) and not any(x in blob for x in _INNER_SPACE)

    def _learn_words(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words not yet known."""
        if self.cut and self._plain(b" ".join(new)):
            return self._cut_words(new)
        plain = np.fromiter((bool(self.cut) and self._plain(w) for w in new), bool, len(new))
        other = [new[i].decode() for i in np.flatnonzero(~plain).tolist()]
        some = [new[i] for i in np.flatnonzero(plain).tolist()]
        return _merged(plain, self._cut_words(some), self._encode(self.tokenizer, other))

    def _cut_words(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Words of letters are one pre-token each, with one mark behind them two; the others are cut by the file's pattern."""
        lowered = pc.split_pattern(pa.array([b"\n".join(new).decode().lower()], pa.large_string()), "\n").flatten()[: len(new)]
        alone = pc.utf8_is_alpha(lowered)
        rest = pc.filter(lowered, pc.invert(alone))
        stem, tail = pc.utf8_slice_codeunits(rest, start=0, stop=-1), pc.utf8_slice_codeunits(rest, start=-1)
        marked = pc.and_(pc.utf8_is_alpha(stem), pc.is_in(tail, value_set=pa.array([*".,;:!?"], pa.large_string())))
        stem, tail = pc.filter(stem, marked), pc.filter(tail, marked)
        cut = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.filter(rest, pc.invert(marked)), pattern=self.cut, replacement="\\1 "))
        n, k = len(lowered) - len(rest), len(stem)
        both = pa.concat_arrays([stem, tail]).take(pa.array(np.arange(2 * k).reshape(2, k).T.ravel()))
        ids, before = self._laid_out(pa.concat_arrays([pc.filter(lowered, alone), both, cut.flatten()]), self.pieces)
        ends = [before[: n + 1], before[n : n + 2 * k + 1 : 2], before[n + 2 * k + cut.offsets.to_numpy()]]
        a, b, c = ((ids[e[0] : e[-1]], np.diff(e)) for e in ends)
        flags = [x.to_numpy(zero_copy_only=False) for x in (alone, marked)]
        return _merged(flags[0], a, _merged(flags[1], b, c))

    @staticmethod
    def _laid_out(items: pa.Array, cache: Cache) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``items`` in a row, and for each place how many ids stand before it (one place more than items)."""
        numbered = items.dictionary_encode()
        own = cache.numbers(numbered.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist())
        numbers = own[numbered.indices.to_numpy()]
        ids, lengths = cache.young.ids(numbers)
        before = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(lengths, out=before[1:])
        return ids, before

    def _encode_step(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_word:
            got = self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)
            return np.concatenate([np.array(e.ids, np.uint32) for e in got]), np.array([len(e.ids) for e in got], np.int64)
        split = pc.ascii_split_whitespace(texts)
        ids, before = self._laid_out(split.flatten(), self.words)
        return ids, np.diff(before[split.offsets.to_numpy()])

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids in a row, number of each text's) of consecutive texts, a few megabytes of text at a time; nulls are empty."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        size = np.cumsum(pc.binary_length(texts).to_numpy())
        at = 0
        while at < len(texts):
            done = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, done + STEP_BYTES, "right")))
            if to == at + 1 and self.by_word and size[at] - done > 2 * STEP_BYTES:
                parts = [self._encode_step(pa.array([x], pa.large_string()))[0] for x in _stretches(texts[at].as_py())]
                yield np.concatenate(parts), np.array([sum(map(len, parts))])
            else:
                yield self._encode_step(texts[at:to])
            at = to

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit bytes."""
        out = []
        for ids, lengths in self.encode(pa.array(texts, pa.large_string())):
            out += [x.astype("<u4").tobytes() for x in np.split(ids, np.cumsum(lengths)[:-1])]
        return out


def _stretches(text: str) -> Iterator[str]:
    """A very long text in stretches, cut at white space (which separates tokens)."""
    at, n = 0, len(text)
    while at < n:
        to = min(n, at + STEP_BYTES)
        if to < n:
            space = max(text.rfind(c, at, to) for c in " \n\t\r\v\f")
            if space < at:  # a word longer than a stretch stays whole
                found = [i for c in " \n\t\r\v\f" if (i := text.find(c, to)) >= 0]
                space = min(found, default=n - 1)
            to = space + 1
        yield text[at:to]
        at = to


@lru_cache(maxsize=4)
def encoder(path: str) -> TextEncoder:
    """One encoder a Python worker, kept from task to task."""
    return TextEncoder(path)
