"""Words and word windows of many texts at once, as 64-bit hashes, without a Python loop over words.

The words are maximal runs of bytes other than 0x20 and 0x09-0x0D.  In UTF-8 those bytes occur
nowhere inside a longer character, so bytes and code points give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_STEP = U(0x9E3779B97F4A7C15)
_WIN = U(0xD1342543DE82EF95)
_powers = np.ones(1, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, in place."""
    h ^= h >> U(30)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        grown = np.empty(max(n, 2 * len(_powers), 64), dtype=np.uint64)
        grown[0] = 1
        np.multiply.accumulate(np.full(len(grown) - 1, _STEP), out=grown[1:])
        _powers = grown
    return _powers


class Words:
    """``hash``: a hash for each word; ``doc``: its text's number; ``start``, ``end``: its bytes in ``data``;
    ``first``: for each text the number of its first word, and one entry more."""

    __slots__ = ("data", "doc", "end", "first", "hash", "n", "start")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool):
        n = self.n = len(offsets) - 1
        base, stop = int(offsets[0]), int(offsets[-1])
        data = data[base:stop]
        offsets = offsets - base
        self.data = data
        if not len(data):
            self.hash = np.empty(0, np.uint64)
            self.doc = self.start = self.end = np.empty(0, np.int64)
            self.first = np.zeros(n + 1, np.int64)
            return
        gap = SPACE[data]
        cut = np.zeros(len(data), dtype=bool)
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        begins = ~gap
        begins[1:] &= gap[:-1] | cut[1:]
        ends = ~gap
        ends[:-1] &= gap[1:] | cut[1:]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        length = self.end - self.start
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(n), np.diff(self.first))
        if not len(length):
            self.hash = np.empty(0, np.uint64)
            return
        inside = data[~gap]
        at = np.arange(len(inside)) - np.repeat(np.cumsum(length) - length, length)
        table = _BYTE[LOWER] if lower else _BYTE
        value = table[inside] * _powers_to(int(length.max()))[at]
        self.hash = mix(np.add.reduceat(value, np.cumsum(length) - length) + length.astype(np.uint64))

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the words that start ``k`` words of one text, and those windows' hashes."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        h = self.hash[:n].copy()
        for j in range(1, k):
            h *= _WIN
            h += self.hash[j : j + n]
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return at, mix(h[at])

    def second(self, at: np.ndarray, k: int) -> np.ndarray:
        """Another hash of the windows that start at the given words."""
        h = np.zeros(len(at), np.uint64)
        for j in range(k):
            h *= _STEP
            h += mix(self.hash[at + j] ^ _WIN)
        return mix(h)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets; null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), offsets


def chunks(offsets: np.ndarray, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``most`` bytes, or of one text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
