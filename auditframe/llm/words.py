"""Array helpers for texts as bytes: word bounds and hashes of a whole Arrow batch, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: An odd multiplier and its inverse modulo 2**64.
MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
#: Bytes that are looked at together; a longer text makes a slice of its own.
SLICE_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, U)
        steps[0] = 1
        have = np.cumprod(steps, dtype=U)
        if n <= 2 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of 64-bit values (the finaliser of SplitMix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def seeded(x: np.ndarray, seed: int) -> np.ndarray:
    return mix(x + U((seed * MULTIPLIER + 0x632BE59BD9B4E019) % (1 << 64)))


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; nulls are empty."""
    a = batch.column(name)
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    if a.null_count:
        a = a.fill_null("")
    wide = pa.types.is_large_string(a.type)
    offsets = np.frombuffer(a.buffers()[1], np.int64 if wide else np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64) if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES, rows: int = 4096) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes and rows, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(i + rows, max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1))
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """Words of some texts: start and end byte, number of the text, and a 64-bit hash, lower-cased if asked for."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACE, lower: bool = True):
        n, rows = len(data), len(offsets) - 1
        if lower:
            data = LOWER[data]
        inside = ~breaks[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < n)]
        first[edges] = inside[edges]
        last[edges - 1] = inside[edges - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        #: Where the words of each text begin, and the end.
        self.bounds = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(rows), np.diff(self.bounds))
        total = np.zeros(n + 1, U)
        np.cumsum((data.astype(U) + U(1)) * powers(MULTIPLIER, n), dtype=U, out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * powers(INVERSE, n + 1)[self.start])

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def grams(hashes: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of each run of k words inside one text."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    acc = np.zeros(n, U)
    for j in range(k):
        acc = acc * U(MULTIPLIER) + hashes[j : j + n]
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return mix(acc[at]), at
