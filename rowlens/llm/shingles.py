"""Word shingles of texts as 64-bit fingerprints, in numpy.

Words are runs of bytes outside space and U+0009..U+000D, with A-Z in lower
case. A word is hashed once (xxh3), and n word hashes in a row are combined
into one fingerprint, so a text costs a few array operations. Two different
shingles share a fingerprint with probability 2**-64.
"""

from __future__ import annotations

import numpy as np
import xxhash

_K = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _mix(h: np.ndarray) -> np.ndarray:
    out = h ^ (h >> np.uint64(30))
    out *= _A
    out ^= out >> np.uint64(27)
    out *= _B
    out ^= out >> np.uint64(31)
    return out


def fingerprints(ws: list[bytes], n: int) -> np.ndarray:
    """Fingerprints of all shingles in order; fewer than n words make one; none make none."""
    if not ws:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))
    m = min(n, len(h))
    out = np.zeros(len(h) - m + 1, np.uint64)
    for i in range(m):
        out = _mix(out * _K + h[i : len(h) - m + 1 + i])
    return _mix(out + np.uint64(m))
