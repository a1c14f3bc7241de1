"""Vectorised numpy kernels over UTF-8 bytes: word spans, word and shingle hashes.

A word is a maximal run of bytes other than space and 0x09-0x0D, the UTF-8 form of `[^\\x20\\x09-\\x0D]+`.
Hashes are 64-bit polynomial hashes, finished with a bijective mixer.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
#: Bytes handled at once; a longer text is handled alone.
SLICE = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: One odd 64-bit value a byte, from a fixed generator.
SALT = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)

_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, SLICE + (SLICE >> 2))
        for k, b in enumerate((_BASE, _BASE_INV)):
            a = np.full(size, b, U)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of SALT[buf[j]] * base**j over j < i."""
    up, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, U)
    np.cumsum(SALT[buf] * up[:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The mixed hash of every span; equal bytes give equal hashes."""
    _, down = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(U))


def utf8(column: pa.Array) -> list[bytes]:
    """A string column's values as bytes; null is empty."""
    return [b"" if v is None else v.encode() for v in column.to_pylist()]


def tidy() -> None:
    """Give freed memory back: a Python worker lives on, and what it holds counts against its executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def parts(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, so that copies of their texts stay small."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)
        del batch
        tidy()


def slices(texts: list[bytes], limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Index ranges of about `limit` bytes each."""
    a = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield a, i
            a, size = i, 0
        size += len(t) + 1
    if a < len(texts):
        yield a, len(texts)


class Words:
    """The words of some texts: spans in one buffer, where texts are parted by a newline, and each text's range of words."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.buf = np.frombuffer(b"\n".join(texts), np.uint8)
        if lower:
            self.buf = LOWER[self.buf]
        lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.text_end = np.cumsum(lengths + 1) - 1
        self.text_start = self.text_end - lengths
        space = np.ones(len(self.buf) + 2, np.int8)
        space[1:-1] = SPACE[self.buf]
        step = np.diff(space)
        self.start, self.end = np.flatnonzero(step == -1), np.flatnonzero(step == 1)
        self.first = np.searchsorted(self.start, self.text_start)
        self.last = np.searchsorted(self.start, self.text_end)
        self.prefix = prefix_hash(self.buf)

    def hashes(self) -> np.ndarray:
        return span_hash(self.prefix, self.start, self.end)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of every window of n words."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    h = np.zeros(m, U)
    for i in range(n):
        h *= U(_BASE)
        h += words[i : i + m]
    return mix(h)
