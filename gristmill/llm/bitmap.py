"""A bitmap of 64-bit hashes, built distributed and of bounded size: it may hold what it wasn't given, never lack what it was."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gristmill.llm.textkernel import SALT, U, mix

#: Bits for each hash, and the least and most bits of a bitmap (128 KB to 32 MB); chunks that it is merged by.
EACH, LEAST, MOST, CHUNKS = 16, 1 << 20, 1 << 28, 64


class Bitmap:
    """Bits in CHUNKS parts; a hash's part is the lowest digits of its bit's number."""

    def __init__(self, bits: int, raw: np.ndarray | None = None):
        self.bits, self.raw = bits, np.zeros((CHUNKS, bits // CHUNKS // 8), np.uint8) if raw is None else raw

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = mix(hashes ^ SALT[11]) % U(self.bits)
        within = at // U(CHUNKS)
        return (at % U(CHUNKS)).astype(np.int64), (within >> U(3)).astype(np.int64), np.uint8(128) >> (within & U(7)).astype(np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        chunk, place, bit = self._places(hashes)
        np.bitwise_or.at(self.raw, (chunk, place), bit)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        chunk, place, bit = self._places(hashes)
        return (self.raw[chunk, place] & bit) != 0


def of_hashes(hashes: DataFrame, column: str, n: int) -> Bitmap:
    """The bitmap of the n hashes of a long column: one row a chunk and task, merged by chunk."""
    bits = min(MOST, max(LEAST, 1 << (EACH * max(n, 1) - 1).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bitmap(bits)
        for batch in batches:
            own.add(batch.column(0).to_numpy(zero_copy_only=False).view(U))
        for k in np.flatnonzero(own.raw.any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([int(k)]), pa.array([own.raw[k].tobytes()])], names=["chunk", "bits"])

    def merge(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(bits // CHUNKS // 8, np.uint8)
        for part in parts:
            for b in part.column("bits"):
                total |= np.frombuffer(b.as_py(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([total.tobytes()])], names=["chunk", "bits"])

    out = Bitmap(bits)
    merged = hashes.select(column).mapInArrow(mark, "chunk long, bits binary").groupBy("chunk").applyInArrow(merge, "chunk long, bits binary")
    for row in merged.collect():  # CHUNKS rows, MOST bits at most
        out.raw[row.chunk] = np.frombuffer(row.bits, np.uint8)
    return out
