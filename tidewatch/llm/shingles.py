"""Vectorised word-shingle hashing of whole texts.

Lower-cases A-Z only and takes words of bytes other than space, \\t, \\n, \\v, \\f, \\r. A word's hash is a polynomial of
random byte values taken from one running sum over the text; shingles mix the hashes of neighbouring words.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CASED = _BYTE.copy()
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, np.bool_)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_TURN = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_POWERS: list[np.ndarray] = [np.empty(0, np.uint64)] * 2


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, ``n`` at least; one table serves all shorter texts."""
    if len(_POWERS[0]) < n:
        size = 1 << max(12, n.bit_length())
        for k, b in enumerate((_BASE, _INVERSE)):
            _POWERS[k] = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64))))
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str, cased: bool = False) -> np.ndarray:
    """A hash for each word; ``cased`` tells A-Z from a-z."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    gap = _SPACE[raw]
    turn = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    bounds = np.concatenate(([0], turn, [len(raw)]))
    starts, ends = bounds[:-1], bounds[1:]
    own = slice(1, None, 2) if gap[0] else slice(0, None, 2)
    starts, ends = starts[own], ends[own]
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = _powers(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((_CASED if cased else _BYTE)[raw] * up[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of all ``width``-word shingles; fewer words make one shingle, no words none."""
    words = word_hashes(text) if text else np.empty(0, np.uint64)
    n = len(words)
    if not n:
        return words
    k = min(width, n)
    total = words[: n - k + 1] * _TURN[0]
    for j in range(1, k):
        total = total + words[j : n - k + 1 + j] * _TURN[j % 64]
    if n < width:
        total = total + np.uint64(n)
    return np.unique(mix(total))
