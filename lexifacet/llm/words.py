"""Vectorised work on the UTF-8 bytes of a column of texts: words, word hashes, shingles and sets of shingles.

Texts stay in Arrow's own buffers; words are maximal runs of bytes other than
space and TAB..CR, A-Z counts as a-z in every hash. Work goes in chunks of
whole texts of about CHUNK bytes, so memory follows the longest text and not
the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 2_000_000
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _series(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


BYTE = _series(256, 1)[LOWER]
_BASE = 0x9E3779B97F4A7C15 | 1


class Cache(dict):
    """What a process has worked out for itself: it travels to workers empty."""

    def __reduce__(self):
        return Cache, ()


_POWERS = Cache()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    size = 1 << max(21, int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        both = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _POWERS[size] = tuple(both)
    return _POWERS[size]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts, at most 1000 (sets() has 10 bits for them), with about `most` bytes each."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        hi = min(hi, lo + 1000, n)
        yield lo, hi
        lo = hi


class Words:
    """The words of texts lo..hi: start, end (in the chunk's bytes) and, for each text, first (its first word; one more entry at the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, space: np.ndarray = SPACE):
        self.bytes = data[offsets[lo] : offsets[hi]]
        self.offsets = offsets[lo : hi + 1] - offsets[lo]
        self.n = hi - lo
        size = len(self.bytes)
        inside = np.zeros(size + 2, bool)
        inside[1:-1] = ~space[self.bytes]
        head, tail = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        cut = self.offsets[1:-1]
        cut = cut[(cut > 0) & (cut < size)]
        both = inside[cut + 1] & inside[cut]
        head[cut[both]] = True
        tail[cut[both] - 1] = True
        self.start = np.flatnonzero(head)
        self.end = np.flatnonzero(tail) + 1
        self.first = np.searchsorted(self.start, self.offsets)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each lower-cased word, by a running Karp-Rabin sum."""
        power, inverse = _powers(len(self.bytes) + 1)
        run = np.zeros(len(self.bytes) + 1, np.uint64)
        np.cumsum(BYTE[self.bytes] * power[: len(self.bytes)], out=run[1:])
        return mix((run[self.end] - run[self.start]) * inverse[self.start] + (self.end - self.start).astype(np.uint64))

    def shingles(self, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, text, word) of every shingle of k words; with `short`, a text of 1 to k - 1 words is one shingle."""
        words = self.hashes()
        many = np.diff(self.first)
        text = self.text_of_word()
        place = np.arange(len(words)) - self.first[:-1][text]
        at = np.flatnonzero(place + k <= many[text])
        out = [join([words[at + j] for j in range(k)])]
        place_of, text_of = [at], [text[at]]
        for m in range(1, k if short else 0):
            t = np.flatnonzero(many == m)
            at = self.first[t]
            out.append(join([words[at + j] for j in range(m)]))
            place_of.append(at)
            text_of.append(t)
        return np.concatenate(out), np.concatenate(text_of), np.concatenate(place_of)


def join(parts: list[np.ndarray]) -> np.ndarray:
    """The hash of a sequence of words; its length counts."""
    h = np.full(len(parts[0]), len(parts), np.uint64)
    for p in parts:
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) + p
    return mix(h)


def sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(elements, first): the distinct shingles of each text as sorted 54-bit integers, and where each text's begin."""
    h, text, _ = words.shingles(k)
    both = np.sort((text.astype(np.uint64) << np.uint64(54)) | (h >> np.uint64(10)))
    if len(both):
        both = both[np.concatenate([[True], both[1:] != both[:-1]])]
    return both & np.uint64((1 << 54) - 1), np.searchsorted(both >> np.uint64(54), np.arange(words.n + 1, dtype=np.uint64))
