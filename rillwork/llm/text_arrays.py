"""Batches of texts as arrays of code points, and hashes of their windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once: bounds the memory of the arrays, whatever the size of a batch of rows.
CHUNK_POINTS = 1 << 20

MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads every bit of x over the word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= MIX_A
    x ^= x >> np.uint64(27)
    x *= MIX_B
    x ^= x >> np.uint64(31)
    return x


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(all code points, starts of the texts, with the end last). Lone surrogates stay as they are."""
    joined = "".join(texts)
    flat = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=starts[1:])
    return flat, starts


def slices(batch: pa.RecordBatch, text: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch of at most CHUNK_POINTS bytes of text (or one text), nulls as empty texts."""
    lens = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0))
    cut = np.flatnonzero(np.diff(np.cumsum(lens) // CHUNK_POINTS)) + 1
    for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
        if hi > lo:
            part = batch.slice(lo, hi - lo)
            yield part, [t if t is not None else "" for t in part.column(text).to_pylist()]


def sliding(a: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op (minimum or maximum) over each window of `width`, by doubling; len(a) - width + 1 values."""
    if len(a) < width:
        return a[:0]
    out, have = a, 1
    while have * 2 <= width:
        out = op(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = op(out[: len(out) - (width - have)], out[width - have :])
    return out


class WindowHash:
    """64-bit hashes of windows of an array of code points: sum of mixed symbols times powers of an odd base, modulo 2**64."""

    BASE = 0x9E3779B97F4A7C15
    _powers: np.ndarray | None = None
    _inverse: np.ndarray | None = None

    def __init__(self, flat: np.ndarray):
        n = len(flat)
        cls = WindowHash
        if cls._powers is None or len(cls._powers) < n:
            size = max(n, 1 << 16)
            p, q = np.full(size, cls.BASE, np.uint64), np.full(size, pow(cls.BASE, -1, 1 << 64), np.uint64)
            p[0] = q[0] = 1
            cls._powers, cls._inverse = np.multiply.accumulate(p), np.multiply.accumulate(q)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(flat.astype(np.uint64) + np.uint64(1)) * cls._powers[:n], out=self.sums[1:])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of [start, end)."""
        return mix((self.sums[end] - self.sums[start]) * WindowHash._inverse[start])

    def all(self, width: int) -> np.ndarray:
        n = len(self.sums) - 1
        if n < width:
            return np.zeros(0, np.uint64)
        return mix((self.sums[width:] - self.sums[: n - width + 1]) * WindowHash._inverse[: n - width + 1])
