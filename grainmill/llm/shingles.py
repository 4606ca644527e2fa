"""Sets of word shingles as sorted arrays of 64-bit hashes, by numpy over the UTF-8 bytes of a text."""

from __future__ import annotations

import numpy as np

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, np.uint64(base), dtype=np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes."""
    edge = np.flatnonzero(np.diff(np.concatenate(([True], _BLANK[data], [True]))))
    return edge[0::2], edge[1::2]


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word of the text, A-Z taken as a-z."""
    data = np.frombuffer(text.encode("utf-8").translate(_LOWER), dtype=np.uint8)
    start, end = word_bounds(data)
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """The sorted distinct hashes of all runs of ``words`` words; of fewer words, the whole as one; else none."""
    own = word_hashes(text) if text else np.zeros(0, dtype=np.uint64)
    if not len(own):
        return own
    size = min(words, len(own))
    n = len(own) - size + 1
    total = np.full(n, np.uint64(size), dtype=np.uint64)
    for k in range(size):
        total += own[k : k + n] * np.uint64((2 * k + 1) * 0xA0761D6478BD642F % 2**64)
        total = mix(total)
    return np.unique(total)
