"""Vectorised work on byte strings inside tasks: whole pieces of a column at a time, no
per-character Python. Everything here is a pure function of its bytes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_ODD = 0x9E3779B97F4A7C15  # an odd multiplier has an inverse modulo 2**64
_powers = (np.ones(1, U64), np.ones(1, U64))


def release() -> None:
    """Give freed memory back to the system. Workers live on between tasks and stages, and an
    idle one should not hold what its last task needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run: Callable) -> Callable:
    """A function for mapInArrow that releases memory when its task ends."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def tidy_group(run: Callable) -> Callable:
    """The same for applyInArrow, group by group."""

    def tidied(group):
        try:
            return run(group)
        finally:
            release()

    return tidied


def tidy_groups(run: Callable) -> Callable:
    """The same for two groups of a key."""

    def tidied(left, right):
        try:
            return run(left, right)
        finally:
            release()

    return tidied


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (splitmix64's finalizer)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(_ODD))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        n = max(n, 1 << 20)
        both = []
        for base in (_ODD, pow(_ODD, -1, 1 << 64)):
            p = np.full(n, base, U64)
            p[0] = 1
            both.append(np.cumprod(p))
        _powers = tuple(both)
    return _powers


class Spans:
    """64-bit hashes of any spans of a buffer, by prefix sums of a polynomial."""

    def __init__(self, buf: np.ndarray):
        p, self.inverse = _power(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, U64)
        np.cumsum(_BYTE[buf] * p[: len(buf)], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(U64))

    def windows(self, n: int) -> np.ndarray:
        """Of every span of ``n`` bytes."""
        if len(self.sums) <= n:
            return np.zeros(0, U64)
        x = self.sums[n:] - self.sums[:-n]
        x *= self.inverse[: len(x)]
        return mix(x + U64(n))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` neighbours."""
    if len(x) < w:
        return x[:0]
    k = 1
    while 2 * k <= w:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[: len(x) - (w - k)], x[w - k :]) if w > k else x


def anchors(g: np.ndarray, w: int) -> np.ndarray:
    """Position of the minimiser of every ``w`` neighbouring gram hashes: the smallest upper
    half of a hash, the leftmost of ties, so equal windows choose alike wherever they stand."""
    key = (g & U64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=U64)
    return (sliding_min(key, w) & U64(0xFFFFFFFF)).astype(np.int64)


def eights(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes at every place as one number; ``buf`` is padded by 8 zeros first."""
    b = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray((len(b) - 7,), "<u8", b, strides=(1,))


def equal_spans(e: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the spans of ``n`` bytes at ``a`` and at ``b`` are equal; ``e`` from eights()."""
    same = np.ones(len(a), bool)
    left = np.flatnonzero(n > 0)
    k = 0
    while len(left):
        rest = n[left] - k
        x = e[a[left] + k] ^ e[b[left] + k]
        short = rest < 8
        if short.any():
            x[short] &= (U64(1) << (U64(8) * rest[short].astype(U64))) - U64(1)
        same[left[x != 0]] = False
        left = left[(x == 0) & (rest > 8)]
        k += 8
    return same


def column(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks() if values.num_chunks != 1 else values.chunk(0)
    if values.null_count:
        values = values.fill_null("" if pa.types.is_string(values.type) or pa.types.is_large_string(values.type) else b"")
    values = values.cast(pa.large_binary())
    at = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    data = values.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def pieces(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def expand(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] of them), start[1], ..."""
    total = int(count.sum())
    first = np.cumsum(count) - count
    return np.repeat(start - first, count) + np.arange(total)


def stretches(flag: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the maximal runs of true values; a run never goes over a true break
    (the first value of something new)."""
    before = np.concatenate([[False], flag[:-1]])
    start = np.flatnonzero(flag & (~before | breaks))
    after = np.concatenate([flag[1:], [False]])
    cut = np.concatenate([breaks[1:], [True]])
    return start, np.flatnonzero(flag & (~after | cut)) + 1
