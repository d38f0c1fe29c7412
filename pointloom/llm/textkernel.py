"""Vectorised text helpers for Arrow batches inside Spark tasks.

A batch of texts is one byte buffer with document offsets; words, lines and
their 64-bit hashes come from whole-buffer numpy passes instead of per-word
Python.  A word is a maximal run of bytes other than ASCII white space
(0x20, 0x09-0x0D); null texts count as empty.  Hashes depend on nothing but
the bytes, so every task and every retry gets the same values.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled by one numpy pass; a longer document is a pass of its own.
SLICE_BYTES = 1 << 19

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LEAD_BYTE = (np.arange(256) & 0xC0) != 0x80  # one for each code point


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over an array of uint64."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_KEY = mix64(np.arange(256, dtype=np.uint64) + np.uint64(1 << 40))
_PLACE_KEY = mix64(np.arange(4096, dtype=np.uint64)) | np.uint64(1)


def _place_key(n: int) -> np.ndarray:
    if n <= len(_PLACE_KEY):
        return _PLACE_KEY
    return mix64(np.arange(n, dtype=np.uint64)) | np.uint64(1)


#: Bytes of spans hashed at a time, so that the arrays of eight bytes for each of them stay small.
HASH_BYTES = 1 << 19


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of every span; spans are ascending, disjoint and not empty."""
    lens = ends - starts
    out = np.zeros(len(starts), np.uint64)
    upto = np.cumsum(lens)
    lo = 0
    while lo < len(starts):
        begin = upto[lo] - lens[lo]
        hi = max(lo + 1, int(np.searchsorted(upto, begin + HASH_BYTES, side="right")))
        own = lens[lo:hi]
        first = upto[lo:hi] - own - begin
        place = np.arange(int(own.sum())) - np.repeat(first, own)
        chars = data[place + np.repeat(starts[lo:hi], own)]
        out[lo:hi] = np.add.reduceat(_BYTE_KEY[chars] * _place_key(int(own.max()))[place], first)
        lo = hi
    return mix64(out + lens.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


@dataclass
class Texts:
    """Documents of one slice: bytes, and the offsets of documents in them."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def lowered(self) -> Texts:
        return Texts(LOWER[self.data], self.offsets)

    def words(self) -> Words:
        """Spans of words; none crosses from a document into the next."""
        space = IS_SPACE[self.data]
        n = len(space)
        if not n:
            none = np.zeros(0, np.int64)
            return Words(self, none, none, np.zeros(len(self) + 1, np.int64))
        cut = np.zeros(n + 1, bool)
        cut[self.offsets] = True
        before = np.empty(n, bool)
        before[0] = True
        before[1:] = space[:-1]
        starts = np.flatnonzero(~space & (before | cut[:-1]))
        after = np.empty(n, bool)
        after[-1] = True
        after[:-1] = space[1:]
        ends = np.flatnonzero(~space & (after | cut[1:])) + 1
        return Words(self, starts, ends, np.searchsorted(starts, self.offsets))

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and pointer by document of the lines between newlines, empty ones included."""
        newline = np.flatnonzero(self.data == 10)
        starts = np.sort(np.concatenate([self.offsets[:-1], newline + 1]), kind="stable")
        # an end is a newline or the end of a document
        ends = np.sort(np.concatenate([newline, self.offsets[1:]]), kind="stable")
        in_doc = np.searchsorted(self.offsets[1:], newline, side="right")
        counts = np.bincount(in_doc, minlength=len(self)) + 1
        return starts, ends, np.concatenate([[0], np.cumsum(counts)])


@dataclass
class Words:
    texts: Texts
    starts: np.ndarray
    ends: np.ndarray
    ptr: np.ndarray  # words of document i: ptr[i] up to ptr[i + 1]

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)

    def docs(self) -> np.ndarray:
        """Document of each word."""
        return np.repeat(np.arange(len(self.ptr) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        return span_hashes(self.texts.data, self.starts, self.ends)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on; the last k - 1 places are left out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9FB21C651E98DF25) + hashes[j : j + n]
    return mix64(out)


def gram_starts(ptr: np.ndarray, k: int) -> np.ndarray:
    """Word places from which k words of one document follow."""
    n = int(ptr[-1])
    left = np.repeat(ptr[1:], np.diff(ptr)) - np.arange(n)
    return np.flatnonzero(left >= k)


def sums_by(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sum of the values between each pointer and the next."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[ptr[1:]] - total[ptr[:-1]]


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, Texts]]:
    """(first row, texts) for runs of rows of about ``limit`` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), len(column))
        yield lo, Texts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi
