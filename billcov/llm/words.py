"""Vectorised words, lines and hashes over Arrow batches of UTF-8 texts.

Tasks read texts as Arrow binary columns; the text bytes of a batch already lie in one buffer, so
words, lines and their hashes are found with numpy over slices of about ``CHUNK`` bytes, without a
Python step per word.  A single longer text is a slice of its own: texts are never cut.

Hashes are polynomials modulo 2**64 with an odd base, mixed at the end.  They are functions of the
bytes alone, so every task and every machine gets the same value.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18

#: Fixed odd multipliers of the hashes.
BASE = 0x9E3779B97F4A7C15
STEP = 0xC2B2AE3D27D4EB4F
MIX1 = 0xBF58476D1CE4E5B9
MIX2 = 0x94D049BB133111EB

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo 2**64 (kept for slices of the usual size)."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 4096)
        have = np.ones(size, dtype=np.uint64)
        have[1:] = np.uint64(base)
        have = np.multiply.accumulate(have)
        if size <= 8 * CHUNK:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX1)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(MIX2)
    return h ^ (h >> np.uint64(31))


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow, after which the worker hands freed memory back: workers live on between tasks."""

    def inner(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
        if trim is not None:
            trim(0)

    return inner


def slices(texts: pa.Array, chunk: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of rows of about ``chunk`` bytes; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    if not n:
        return
    width = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], dtype=width)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + chunk, side="right")) - 1)
        yield i, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


@dataclass
class Words:
    """Words of a slice in order: byte range, document (row in the slice) and 64-bit hash."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the maximal runs of ``mask`` that don't cross a document's bounds."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.zeros(n, dtype=bool)
    before[1:] = mask[:-1]
    start = np.flatnonzero(mask & (~before | edge[:-1]))
    after = np.zeros(n, dtype=bool)
    after[:-1] = mask[1:]
    end = np.flatnonzero(mask & (~after | edge[1:])) + 1
    return start, end


class Prefix:
    """Prefix sums from which the hash of any byte range comes in a step."""

    def __init__(self, raw: np.ndarray) -> None:
        n = len(raw)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        # The value grows towards the front, so a range's sum is divided by a power of the base:
        # powers are taken from the back, and odd numbers can be divided modulo 2**64.
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=self.sums[1:])
        self.inverse = powers(pow(BASE, -1, 1 << 64), n + 1)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def words_of(raw: np.ndarray, offsets: np.ndarray, mask: np.ndarray | None = None, prefix: Prefix | None = None) -> Words:
    """Words (runs of ``mask``; by default of bytes outside [\\x20\\x09-\\x0D]) with hashes."""
    start, end = runs(~SPACE[raw] if mask is None else mask, offsets)
    doc = np.searchsorted(offsets, start, side="right") - 1
    prefix = prefix or Prefix(raw)
    return Words(start, end, doc, prefix.hash(start, end))


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of first word, hash) of every ``k``-word window that lies in one document."""
    n = len(w.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.flatnonzero(w.doc[:n] == w.doc[k - 1 :])
    h = np.zeros(len(first), dtype=np.uint64)
    for i in range(k):
        h = h * np.uint64(STEP) + w.hash[first + i]
    return first, mix(h)


def per_doc_sum(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` (one per byte) over each document."""
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]
