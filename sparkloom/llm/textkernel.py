"""Words and word-shingle hashes straight from Arrow string buffers, without Python strings.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. A word's hash is a polynomial over
its bytes modulo 2**64 with an odd base, then mixed with its length; it doesn't depend on where the
word stands, so equal words have equal hashes in every batch and on every executor.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 18

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Gives the process's free memory back to the system."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def released(run: Callable, *drop: Callable) -> Callable:
    """A function of batches like ``run``, after which the worker, which Spark keeps for other tasks, gives free memory back.

    drop: called first, to empty caches.
    """

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            for f in drop:
                f()
            give_back()

    return wrapped


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, U(base), U)
    out[:1] = 1
    return np.multiply.accumulate(out, dtype=U)


class _Powers:
    up = down = np.zeros(0, U)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = powers(max(n, _BLOCK), _BASE), powers(max(n, _BLOCK), _INV)
        return cls.up, cls.down


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values with good avalanche (the finalizer of splitmix64)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (one more than rows) of a string array; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def word_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the index of its first word (one more than texts)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = ~SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True  # a text's first byte, and one behind its last
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(fresh), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, computed block by block."""
    out = np.empty(len(starts), U)
    k = 0
    while k < len(starts):
        stop = max(k + 1, int(np.searchsorted(ends, starts[k] + _BLOCK, "right")))
        lo, hi = int(starts[k]), int(ends[stop - 1])
        up, down = _Powers.get(hi - lo + 1)
        part = raw[lo:hi]
        sums = np.zeros(hi - lo + 1, U)
        np.cumsum((LOWER[part] if lower else part).astype(U) * up[: hi - lo], out=sums[1:])
        s, e = starts[k:stop] - lo, ends[k:stop] - lo
        out[k:stop] = (sums[e] - sums[s]) * down[s] + (e - s).astype(U) * U(0xD6E8FEB86659FD93)
        k = stop
    return mix(out)


def shingle_sets(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct k-word shingle hashes, sorted, and offsets (one more than texts).

    A text of fewer than k words, but of one at least, has its whole sequence as its only shingle.
    """
    n = len(words) - k + 1
    if n > 0:
        rolled = words[:n].copy()
        for j in range(1, k):
            rolled *= U(0x9FB21C651E98DF25)
            rolled ^= rolled >> U(29)
            rolled += words[j : n + j]
        rolled = mix(rolled)
    parts, sizes = [], np.zeros(len(first), np.int64)
    for d in range(len(first) - 1):
        a, b = int(first[d]), int(first[d + 1])
        if b - a >= k:
            own = np.sort(rolled[a : b - k + 1])
            if len(own) > 1:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif b > a:
            value = b - a
            for w in words[a:b].tolist():
                value = ((value * 0x9FB21C651E98DF25) ^ w) & 0xFFFFFFFFFFFFFFFF
                value ^= value >> 31
            own = mix(np.array([value], U))
        else:
            continue
        parts.append(own)
        sizes[d + 1] = len(own)
    return (np.concatenate(parts) if parts else np.zeros(0, U)), np.cumsum(sizes)


def text_shingles(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    raw, at = text_bytes(column)
    starts, ends, first = word_spans(raw, at)
    return shingle_sets(word_hashes(raw, starts, ends), first, k)


def blocks(at: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Row ranges whose elements, counted by offsets ``at``, are about ``size`` in number."""
    out, a = [], 0
    while a < len(at) - 1:
        b = max(a + 1, int(np.searchsorted(at, at[a] + size, "right")) - 1)
        out.append((a, b))
        a = b
    return out


def row_slices(column: pa.Array, size: int = 1 << 19) -> list[tuple[int, int]]:
    """Row ranges of a string array of about ``size`` bytes each."""
    _, at = text_bytes(column)
    return blocks(at, size)
