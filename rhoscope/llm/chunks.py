"""Content hashes over byte buffers, vectorised in numpy."""

from __future__ import annotations

import numpy as np

_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every ``k`` consecutive bytes; ``k`` is a power of two.

    ``out[i]`` depends on ``data[i:i+k]`` alone.  Hashes of n bytes combine to
    hashes of 2n bytes, so k = 32 takes five passes.
    """
    if len(data) < k:
        return np.empty(0, np.uint64)
    h = (data.astype(np.uint64) + np.uint64(1)) * _ODD[0]
    n = 1
    while n < k:
        a, b = h[: len(h) - n], h[n:]
        h = a * _ODD[1] + b
        h ^= h >> np.uint64(31)
        h *= _ODD[0]
        n *= 2
    return h


def cuts(raw: bytes, average: int = 512, gram: int = 16) -> list[int]:
    """Ends of content-defined chunks of ``raw`` (UTF-8), the last is its length.

    A cut follows every 16-gram whose rolling hash has enough low zero bits and
    is not followed by a continuation byte, so that every chunk is valid UTF-8.
    """
    if not raw:
        return []
    data = np.frombuffer(raw, np.uint8)
    h = gram_hashes(data, gram)
    at = np.flatnonzero((h >> np.uint64(20)) % np.uint64(average) == 0) + gram
    at = at[at < len(data)]
    at = at[(data[at] & 0xC0) != 0x80]
    return [*at.tolist(), len(data)]
