"""Vectorised scanning of whole text columns: word bounds, 64-bit word hashes, shingles.

All functions work on the byte buffer of an Arrow string column, so a batch costs a fixed number
of numpy calls and no Python object is made per word. Words are runs of bytes other than
0x20 and 0x09-0x0D; in UTF-8 these six bytes never occur inside another character, so byte words
and code-point words are the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
BLOCK_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.Generator(np.random.PCG64(20240611))
_TABLE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
M1, M2, M3 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> U(30))
    x *= M1
    x ^= x >> U(27)
    x *= M2
    x ^= x >> U(31)
    return x


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        size = max(BLOCK_BYTES + 1, n)
        have = np.ones(size, np.uint64)
        have[1:] = U(base)
        np.multiply.accumulate(have, out=have)
        if size > 8 * BLOCK_BYTES:
            return have
        _powers[str(base)] = have
    return have


@dataclass
class Block:
    """Consecutive documents: rows ``first`` to ``last`` of a batch, their bytes and their words."""

    first: int
    last: int
    data: np.ndarray  # bytes of all texts
    bounds: np.ndarray  # len(docs)+1 offsets into data
    starts: np.ndarray  # of words, in data
    ends: np.ndarray
    word_bounds: np.ndarray  # len(docs)+1 offsets into starts

    @property
    def n_docs(self) -> int:
        return self.last - self.first

    def n_words(self) -> np.ndarray:
        return np.diff(self.word_bounds)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.n_words())

    def word_hashes(self, lower: bool) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends, lower)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of data[start:end] for each pair, by prefix sums of a polynomial."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER if lower else _TABLE)[data] * _power(_BASE, n)[:n], out=sums[1:])
    value = (sums[ends] - sums[starts]) * _power(_INVERSE, n + 1)[starts]
    return mix(value + (ends - starts).astype(np.uint64) * M3)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (length+1) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def groups(off: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text is a range of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def blocks(column: pa.Array, limit: int = BLOCK_BYTES, gap: np.ndarray = SPACE) -> Iterator[Block]:
    """Blocks of a column; ``gap`` tells which bytes stand between words."""
    buffer, off = text_buffers(column)
    for i, j in groups(off, limit):
        data, bounds = buffer[off[i] : off[j]], off[i : j + 1] - off[i]
        inside = ~gap[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[bounds] = True
        before = np.empty(len(data), bool)
        before[:1] = False
        before[1:] = inside[:-1]
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        yield Block(i, j, data, bounds, starts, ends, np.searchsorted(starts, bounds))


def trigrams(hashes: np.ndarray, word_bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of 3-word windows, and offsets by document (length docs+1); windows stay in a text."""
    n = np.diff(word_bounds)
    per = np.maximum(n - 2, 0)
    bounds = np.concatenate([[0], np.cumsum(per)])
    if not bounds[-1]:
        return np.zeros(0, np.uint64), bounds
    at = np.arange(bounds[-1]) + np.repeat(word_bounds[:-1] - bounds[:-1], per)
    return mix(hashes[at] * M1 + hashes[at + 1] * M2 + hashes[at + 2] * M3), bounds
