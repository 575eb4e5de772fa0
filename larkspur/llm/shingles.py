"""Hashes of word shingles of many texts at once, over the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
#: Bytes of text hashed at once; a longer text goes alone.
SLICE = 400_000

_rng = np.random.default_rng(20_240_501)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_PLACE = _rng.integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over all others; one value for each value."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE + 1)
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if size <= 4 * SLICE:
            _powers[base] = have
    return have[:n]


def word_hashes(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and text number of every word; texts are data[edges[i]:edges[i + 1]], words the runs without ASCII white space."""
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    solid = ~_SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    cuts = edges[(edges > 0) & (edges < n)]
    first[cuts] = solid[cuts]
    last[cuts - 1] = solid[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_VALUE[_LOWER[data]] * _power(_BASE, n), dtype=np.uint64, out=sums[1:])
    hashes = mix((sums[end + 1] - sums[start]) * _power(_INVERSE, n)[start])
    return hashes, np.searchsorted(edges, start, side="right") - 1


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row. Fewer words than a shingle has are one shingle; none give an empty set."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    whole = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + SLICE, side="right")) - 1)
        high = min(high, len(texts))
        edges = offsets[low : high + 1] - offsets[low]
        hashes, of = word_hashes(whole[offsets[low] : offsets[high]], edges)
        bounds = np.searchsorted(of, np.arange(high - low + 1))
        runs = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
        for k in range(words if len(runs) else 0):
            runs += hashes[k : k + len(runs)] * _PLACE[k]
        runs = mix(runs)
        for i in range(high - low):
            a, b = int(bounds[i]), int(bounds[i + 1])
            if b - a >= words:
                yield low + i, np.unique(runs[a : b - words + 1])
            elif b > a:
                # the number of words counts too
                yield low + i, mix(np.array([int((hashes[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64)) ^ (b - a)], dtype=np.uint64))
            else:
                yield low + i, np.empty(0, np.uint64)
        low = high
