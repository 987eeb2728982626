"""Vectorised text helpers for Arrow batches: slicing, words, hashes, shingles.

All functions work on UTF-8 bytes.  The word separators used here are ASCII, so
cutting bytes never cuts a code point.  Hashes are 64 bits wide, the same on
every machine, and are computed over whole words.  Equal hashes stand for equal
words: among a billion distinct words some pair collides with a chance of 3 %, and
texts crafted to collide can; where that is not acceptable, compare the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are handled in runs of about this many bytes (a run takes some 60 times
#: its size in a worker); one text is never cut.
SLICE_BYTES = 1 << 20
_GOLD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_BASE = 0xD1342543DE82EF95


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers (in place on a fresh array)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit integers that depend on the seed alone."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 7919)) * np.uint64(_GOLD))


_BYTE = stream(17, 256)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            run = np.full(size, base, np.uint64)
            run[0] = 1
            _POWERS[k] = np.cumprod(run, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


#: Bytes that belong to a word, for the two word rules of the contracts.
BLANK_WORDS = np.ones(256, bool)
BLANK_WORDS[[0x20, *range(0x09, 0x0E)]] = False
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def slices(column, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, row after the last, bytes, offsets from 0)."""
    data, offsets = buffers(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


class Words:
    """The words of a run of texts: starts, ends (bytes), text numbers, hashes.

    first[d] is the number of the first word of text d (len texts + 1)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool = False, hashed: bool = True):
        if lower:
            data = LOWER[data]
        self.data, self.offsets = data, offsets
        n = len(data)
        inside = table[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], after[-1] = False, False
            before[1:], after[:-1] = inside[:-1], inside[1:]
            before &= ~edge[:-1]
            after &= ~edge[1:]
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets, "left")
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.counts)
        self.hash = self._hashes() if hashed else None

    @classmethod
    def of_hashes(cls, hashes: np.ndarray, counts: np.ndarray) -> "Words":
        """The words of several texts by their hashes alone."""
        out = cls.__new__(cls)
        out.hash, out.starts, out.counts = hashes, np.arange(len(hashes)), counts
        out.first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        out.doc = np.repeat(np.arange(len(counts)), counts)
        return out

    def _hashes(self) -> np.ndarray:
        power, _ = _powers(len(self.data) + 1)
        self._total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * power[: len(self.data)], out=self._total[1:])
        return self.span_hash(self.starts, self.ends)

    def span_hash(self, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
        """Hashes of byte spans, whole words or parts; equal spans hash alike."""
        value = (self._total[ends] - self._total[starts]) * _powers(len(self.data) + 1)[1][starts]
        return mix(value ^ ((ends - starts).astype(np.uint64) * np.uint64(_GOLD)) ^ np.uint64(salt << 56))

    def chain(self, length: int) -> np.ndarray:
        """Hash of the `length` words from each word on (of what follows in the
        run, so only positions with enough words in their text are meaningful)."""
        n = len(self.hash)
        out = self.hash.copy()
        for k in range(1, length):
            nxt = np.zeros(n, np.uint64)
            if k < n:
                nxt[: n - k] = self.hash[k:]
            out = mix(out * np.uint64(_GOLD) + nxt)
        return out

    def left(self) -> np.ndarray:
        """Words from each word to the end of its text, itself included."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.starts))


def shingle_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first) of the word windows of each text; a text of fewer than
    `size` words, but not none, has one window of all its words."""
    counts = np.where(words.counts >= size, words.counts - size + 1, np.minimum(words.counts, 1))
    first = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(first[-1]) - np.repeat(first[:-1], counts) + np.repeat(words.first[:-1], counts)
    out = words.chain(size)[at] if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    for length in range(1, size):
        those = short[words.counts[short] == length]
        if len(those):
            value = words.hash[words.first[those]]
            for k in range(1, length):
                value = mix(value * np.uint64(_GOLD) + words.hash[words.first[those] + k])
            out[first[those]] = mix(value + np.uint64(length))
    return out, first
