"""Vectorised word scanning and hashing over Arrow string arrays, for code that runs in Python workers.

A word is a maximal run of bytes other than ASCII white space (space, tab, LF, VT, FF, CR).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_P = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and grown as longer inputs come."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, dtype=U64)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def _spread(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hashes of values[start:end], from prefix sums modulo 2**64."""
    n = len(values)
    total = np.zeros(n + 1, dtype=U64)
    np.cumsum(values * powers(base, n), out=total[1:])
    return (total[ends] - total[starts]) * powers(pow(base, -1, 1 << 64), n + 1)[starts]


def release() -> None:
    """Give freed Arrow memory back: workers live on, and the next stage's run beside it."""
    pa.default_memory_pool().release_unused()


def as_strings(column: pa.Array) -> pa.Array:
    """Text as a plain string array, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.string()) if column.type != pa.string() else column
    return column.fill_null("")


def slices(texts: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes together; a longer row is a range of its own."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + most, side="right")) - 1)
        yield begin, min(end, len(texts))
        begin = end


class Words:
    """The words of some rows: data is their bytes; word k is data[start[k]:end[k]]; row r has the words first[r]:first[r + 1]."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        low, high = (int(offsets[0]), int(offsets[-1])) if len(texts) else (0, 0)
        body = texts.buffers()[2]
        self.data = np.frombuffer(body, dtype=np.uint8)[low:high] if body is not None and high > low else np.zeros(0, np.uint8)
        if lower:
            self.data = np.where((self.data >= 65) & (self.data <= 90), self.data + 32, self.data).astype(np.uint8)
        offsets = offsets - low
        solid = ~_SPACE[self.data]
        before = np.zeros(len(solid), dtype=bool)
        before[1:] = solid[:-1]
        after = np.zeros(len(solid), dtype=bool)
        after[:-1] = solid[1:]
        inner = offsets[(offsets > 0) & (offsets < len(solid))]
        before[inner] = False
        after[inner - 1] = False
        self.start = np.flatnonzero(solid & ~before)
        self.end = np.flatnonzero(solid & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.bytes = offsets

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return mix(_spread(self.data.astype(U64) + U64(1), self.start, self.end, _P))


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word windows of one row's word hashes, by first word."""
    if len(words) < n:
        return np.zeros(0, dtype=U64)
    starts = np.arange(len(words) - n + 1)
    return mix(_spread(words, starts, starts + n, 0xD1342543DE82EF95))


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of values[start:start + length]."""
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat(starts.astype(np.int64) - (ends - lengths), lengths)
    at += np.arange(total)
    return values[at]
