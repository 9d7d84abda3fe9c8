"""Vectorised text kernels for tasks: word hashes, shingles and minhash over one Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_RANDOM = np.random.Generator(np.random.PCG64(1))
#: A random odd number for every byte; A-Z has the numbers of a-z.
_BYTE = _RANDOM.integers(0, 2**63, 256, dtype=U) * U(2) + U(1)
_BYTE[65:91] = _BYTE[97:123]
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
_STEP = U(0x9E3779B97F4A7C15)
#: Text bytes that one round of numpy works on.
SLICE_BYTES = 2 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about SLICE_BYTES of text, one row at least."""
    if not batch.num_rows:
        return
    sizes = np.maximum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64), 1)
    part = (np.cumsum(sizes) - sizes) // SLICE_BYTES
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        yield batch.slice(a, b - a)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array and the offset of each row; null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


class Words:
    """The words of a string array: hash (of the word with A-Z lower-cased), first and last byte, and
    where the words of each row begin (ptr)."""

    def __init__(self, texts: pa.Array):
        self.data, self.rows = text_bytes(texts)
        n = len(self.data)
        white = _WHITE[self.data]
        cut = np.zeros(n + 1, bool)
        cut[self.rows] = True
        before = np.empty(n, bool)
        before[:1] = True
        before[1:] = white[:-1]
        starts = np.flatnonzero(~white & (before | cut[:n]))
        after = np.empty(n, bool)
        after[-1:] = True
        after[:-1] = white[1:]
        ends = np.flatnonzero(~white & (after | cut[1:])) + 1
        self.starts, self.ends = starts, ends
        self.ptr = np.searchsorted(starts, self.rows)
        if not len(starts):
            self.hash = np.empty(0, U)
            return
        lens = ends - starts
        firsts = np.cumsum(lens) - lens
        codes = self.data[~white]
        place = np.arange(len(codes)) - np.repeat(firsts, lens)
        powers = np.full(int(lens.max()), _STEP, U)
        powers[0] = U(1)
        powers = np.multiply.accumulate(powers)
        self.hash = mixed(np.add.reduceat(_BYTE[codes] * powers[place], firsts) ^ lens.astype(U))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for every run of k words."""
    if len(words) < k:
        return np.empty(0, U)
    n = len(words) - k + 1
    out = words[:n].copy()
    for i in range(1, k):
        out = out * _STEP + words[i : i + n]
    return mixed(out)


def document_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct k-word shingles; of fewer words the whole sequence as one; of none nothing."""
    if 0 < len(words) < k:
        return shingles(words, len(words)) ^ U(len(words))
    return np.unique(shingles(words, k))


def set_name(items: np.ndarray) -> bytes:
    """128 bits that name a sorted set."""
    place = np.arange(1, len(items) + 1, dtype=U)
    a = mixed(items + place * _STEP).sum(dtype=U)
    b = mixed(mixed(items ^ U(0xD6E8FEB86659FD93)) + place).sum(dtype=U)
    return np.array([a, b], U).tobytes()


class MinHash:
    """count minimum values under random linear maps of 64 bits."""

    def __init__(self, count: int, seed: int):
        random = np.random.Generator(np.random.PCG64(seed))
        self.a = random.integers(0, 2**63, count, dtype=U) * U(2) + U(1)
        self.b = random.integers(0, 2**64, count, dtype=U)

    def of(self, items: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        """One row of minima for each stretch of items that begins at ptr; no stretch may be empty."""
        out = np.empty((len(ptr), len(self.a)), U)
        for j in range(len(self.a)):
            out[:, j] = np.minimum.reduceat(items * self.a[j] + self.b[j], ptr)
        return out
