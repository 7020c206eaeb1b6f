"""Hashed n-grams of whole texts in numpy, window by window."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

#: Characters that are held at a time; texts of any length go through in overlapping windows.
WINDOW = 1 << 20


def windows(text: str, overlap: int, size: int = WINDOW) -> Iterator[str]:
    """Pieces of text, each beginning with the last `overlap` characters of the one before."""
    if len(text) <= size:
        yield text
        return
    for start in range(0, len(text), size):
        yield text[max(0, start - overlap) : start + size]


def codes(text: str) -> np.ndarray:
    """Code points; lone surrogates stay as they are."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def buckets(x: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Hashes to `bits` bits of the n-grams of 16-bit codes x; n is 4 at most, so keys are exact before hashing."""
    if len(x) < n:
        return np.empty(0, np.int64)
    x = x.astype(np.uint64)
    key = x[: len(x) - n + 1].copy()
    for k in range(1, n):
        key <<= np.uint64(16)
        key |= x[k : len(x) - n + 1 + k]
    key ^= key >> np.uint64(29)
    key *= np.uint64(0x9E3779B97F4A7C15 + 2 * n)
    key ^= key >> np.uint64(32)
    key *= np.uint64(0xD6E8FEB86659FD93)
    return (key >> np.uint64(64 - bits)).astype(np.int64)


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    r = 0x5851F42D4C957F2D
    up = np.full(size, r, np.uint64)
    down = np.full(size, pow(r, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def words(x: np.ndarray, space: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each maximal run of codes x that are not space."""
    if not len(x):
        return np.empty(0, np.uint64)
    size = 1 << 12
    while size < len(x):
        size <<= 1
    up, down = _powers(size)
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[: len(x)], out=total[1:])
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True]))))
    start, end = edge[::2], edge[1::2]
    return (total[end] - total[start]) * down[start]
