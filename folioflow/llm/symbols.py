"""Vectorised byte and word kernels over Arrow string columns (numpy, no per-symbol Python)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
#: Symbols per slice of a vector kernel: temporaries of this length stay in the CPU's cache.
SLICE = 1 << 16

_rng = np.random.default_rng(20240607)
#: A random 64-bit value per byte, and an odd multiplier, for polynomial hashes modulo 2**64.
BYTE_CODE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + _rng.integers(0, 2, 256, dtype=np.uint64)
RADIX = U64(0x9E3779B97F4A7C15)

#: The white space of the word pattern [^\x20\x09-\x0D]+.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise a polynomial hash so that every output bit depends on every input bit."""
    h = h ^ (h >> U64(32))
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


def power(exponent: int) -> np.uint64:
    return U64(pow(int(RADIX), exponent, 1 << 64))


def gram_hash(codes: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of each k consecutive codes (length n - k + 1), by binary composition."""
    n = len(codes)
    if n < k:
        return np.empty(0, U64)
    acc, have, cur, width = None, 0, codes, 1
    while True:
        if k & width:
            if acc is None:
                acc, have = cur, width
            else:
                m = min(len(acc), len(cur) - have)
                acc = acc[:m] * power(width) + cur[have : have + m]
                have += width
        if width * 2 > k:
            return acc[: n - k + 1]
        cur = cur[: len(cur) - width] * power(width) + cur[width:]
        width *= 2


def slide(values: np.ndarray, w: int, op) -> np.ndarray:
    """op (np.minimum or np.maximum) over each w consecutive values (length n - w + 1)."""
    cur, width = values, 1
    while width * 2 <= w:
        cur = op(cur[: len(cur) - width], cur[width:])
        width *= 2
    rest = w - width
    return op(cur[: len(cur) - rest], cur[rest:]) if rest else cur


@dataclass
class Texts:
    """A batch of texts as one byte buffer: text i is data[start[i]:end[i]]. Nulls are empty."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray

    @classmethod
    def of(cls, column: pa.Array | pa.ChunkedArray) -> Texts:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        column = pc.fill_null(column.cast(pa.large_string()), "")
        if not len(column):
            return cls(np.empty(0, np.uint8), np.empty(0, np.int64), np.empty(0, np.int64))
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
        return cls(raw[at[0] : at[-1]], at[:-1] - at[0], at[1:] - at[0])

    def __len__(self) -> int:
        return len(self.start)

    def blocks(self, most: int):
        """Runs of texts with about ``most`` bytes in all (a longer text stands alone), as (i, j)."""
        i = 0
        while i < len(self):
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + most, "right")))
            yield i, j
            i = j


@dataclass
class Words:
    """Words of a batch: word w is bytes start[w]:end[w]; text i has words first[i]:first[i + 1]."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, texts: Texts) -> Words:
        solid = ~IS_SPACE[texts.data]
        begins, ends = solid.copy(), solid.copy()
        if len(solid):
            begins[1:] &= ~solid[:-1]
            ends[:-1] &= ~solid[1:]
            filled = texts.end > texts.start
            head, tail = texts.start[filled], texts.end[filled] - 1
            begins[head] = solid[head]
            ends[tail] = solid[tail]
        start = np.flatnonzero(begins)
        first = np.searchsorted(start, np.append(texts.start, len(solid)))
        return cls(start, np.flatnonzero(ends) + 1, first)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span data[start:end], spans ascending and disjoint."""
    out = np.zeros(len(start), U64)
    if not len(start):
        return out
    if int((end - start).max()) > SLICE:
        # Very long spans need no table of powers as long as they are.
        large = end - start > SLICE
        out[~large] = span_hash(data, start[~large], end[~large])
        out[large] = [xxhash.xxh3_64_intdigest(data[s:e]) for s, e in zip(start[large].tolist(), end[large].tolist())]
        return out
    longest = int((end - start).max())
    powers = np.cumprod(np.full(longest + 1, RADIX))
    step = max(1, (4 * SLICE) // max(1, int((end - start).mean()) + 1))
    for a in range(0, len(start), step):
        s, e = start[a : a + step], end[a : a + step]
        length = e - s
        edge = np.cumsum(length) - length
        within = np.arange(int(length.sum())) - np.repeat(edge, length)
        terms = BYTE_CODE[data[np.repeat(s, length) + within]] * powers[within]
        if len(terms):
            full = length > 0
            sums = np.zeros(len(s), U64)
            sums[full] = np.add.reduceat(terms, edge[full])
            out[a : a + step] = sums + length.astype(U64) * U64(0xC2B2AE3D27D4EB4F)
    return mix(out)
