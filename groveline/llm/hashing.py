"""Hashes of bytes, words and windows for whole Arrow batches of texts, as numpy arrays.

A stretch of tokens is hashed as the difference of two prefix sums of random token values times powers of an odd base modulo
2**64, shifted to position 0 and mixed; equal stretches have equal hashes wherever they stand.
"""

from __future__ import annotations

import ctypes
import functools
import inspect
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time. A longer text is worked on alone, with some 60 bytes of memory for each of its own.
STRETCH = 1 << 19
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
BASES = (0x9E3779B97F4A7C15 | 5, 0xC2B2AE3D27D4EB4F & ~7 | 5)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, ``size`` or more of them; the longest that were asked for are kept."""
    if which not in _POWERS or len(_POWERS[which][0]) < size:
        base = BASES[which]
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.ones(size, np.uint64)
            p[1:] = np.uint64(b)
            out.append(np.multiply.accumulate(p))
        _POWERS[which] = out[0], out[1]
    return _POWERS[which]


@lru_cache(maxsize=4)
def byte_values(which: int) -> np.ndarray:
    return np.random.default_rng(1000 + which).integers(0, 1 << 64, 256, np.uint64)


def release() -> None:
    """Gives free memory back to the system: workers stay for the next task, and what they keep counts against their executor."""
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def tidy(f):
    """f, a kernel over batches or over whole groups, with ``release`` at its end."""

    @functools.wraps(f)
    def batches(*args):
        try:
            yield from f(*args)
        finally:
            release()

    @functools.wraps(f)
    def group(*args):
        try:
            return f(*args)
        finally:
            release()

    out = batches if inspect.isgeneratorfunction(f) else group
    out.__signature__ = inspect.signature(f)  # Spark counts the arguments
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


class Prefix:
    """Hashes of any stretches of a token array."""

    def __init__(self, values: np.ndarray, which: int = 0):
        size = 1 << max(12, int(len(values)).bit_length())
        self.power, self.inverse = _powers(which, size)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.power[: len(values)], out=self.sums[1:])

    def window(self, length: int) -> np.ndarray:
        """Of the stretches of one length at every start."""
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * self.inverse[:n]) if n > 0 else np.empty(0, np.uint64)

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.inverse[start])


class Texts:
    """The UTF-8 bytes of an Arrow string column, one after another, without copies of single texts. A null text is empty."""

    def __init__(self, column: pa.Array):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
        _, offsets, data = column.buffers()
        self.offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        self.data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
        if column.null_count:  # what stands at a null's place isn't text
            valid = np.asarray(column.is_valid())
            lengths = np.where(valid, np.diff(self.offsets), 0)
            parts = [self.data[a : a + n] for a, n in zip(self.offsets[:-1], lengths, strict=True)]
            self.data = np.concatenate([*parts, np.empty(0, np.uint8)])
            self.offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def groups(self) -> Iterator[tuple[int, int]]:
        """Ranges of rows with about STRETCH bytes, one row at least."""
        row = 0
        while row < len(self):
            stop = int(np.searchsorted(self.offsets, self.offsets[row] + STRETCH, "right")) - 1
            yield row, (stop := min(len(self), max(row + 1, stop)))
            row = stop

    def bytes(self, first: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets from 0) of the rows first to stop."""
        at = self.offsets[first : stop + 1]
        return self.data[at[0] : at[-1]], at - at[0]


_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, byte after, of each word; offsets of the rows' words) for the texts that stand one after another in data."""
    n = len(data)
    if lower:
        data = _LOWER[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    letter = ~_SPACE[data]
    before = np.zeros(n, bool)
    before[1:] = letter[:-1]
    start = np.flatnonzero(letter & (~before | edge[:n]))
    after = np.ones(n, bool)
    after[:-1] = ~letter[1:]
    stop = np.flatnonzero(letter & (after | edge[1:])) + 1
    hashed = Prefix(byte_values(0)[data]).of(start, stop) if len(start) else np.empty(0, np.uint64)
    return hashed, start, stop, np.searchsorted(start, offsets)


def rows_of(offsets: np.ndarray) -> np.ndarray:
    """The row of each token."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def minimizers(grams: np.ndarray, offsets: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring window starts that have the same least gram: (row, first start, last start, the gram's start).

    grams: hash of the gram at each token, as many as tokens - gram + 1. The least gram of a window, the first of equals, depends on
    the window's tokens only; so equal windows have equal least grams at equal places, wherever they stand.
    """
    bits = np.uint64(max(1, int(len(grams)).bit_length()))
    key = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    width, have = window - gram + 1, 1
    while have < width:  # least of twice as many, the last time of fewer more
        step = min(have, width - have)
        key = np.minimum(key[:-step], key[step:]) if len(key) > step else key[:0]
        have += step
    starts = np.concatenate([np.arange(a, max(a, b - window + 1)) for a, b in zip(offsets[:-1], offsets[1:], strict=True)] or [np.empty(0, np.int64)]).astype(np.int64)
    if not len(starts):
        none = np.empty(0, np.int64)
        return none, none, none, none
    least = (key[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (np.diff(least) != 0) | (np.diff(starts) != 1)]))
    # a text's last window and the next text's first never touch, but for a window of one token
    first, last = starts[new], starts[np.concatenate([new[1:], [len(starts)]]) - 1]
    return np.searchsorted(offsets, first, "right") - 1, first, last, least[new]
