"""Hashes of words and word shingles, computed for many texts at once with numpy.

A word's hash is a polynomial of byte values modulo 2**64, read off prefix sums and mixed; a
shingle's is a sum of its words' hashes, each times its place's odd factor, mixed again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_UNDO = pow(_BASE, -1, 1 << 64)
_VALUE = np.array([int.from_bytes(hashlib.md5(b"%d" % b).digest()[:8], "little") | 1 for b in range(256)], U)
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_FACTOR = [int.from_bytes(hashlib.md5(b"place%d" % k).digest()[:8], "little") | 1 for k in range(64)]
#: Texts are hashed in groups of about so many bytes, to bound memory.
GROUP_BYTES = 1 << 18

_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    key = str(base)
    if len(_powers.get(key, ())) < n:
        steps = np.full(max(n, GROUP_BYTES + (1 << 17)), base, U)
        steps[0] = 1
        _powers[key] = np.multiply.accumulate(steps)
    return _powers[key][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def groups(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts whose bytes together are about GROUP_BYTES, one text at least."""
    start = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > GROUP_BYTES:
            yield start, k
            start, size = k, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, the text it belongs to)."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    gap = _GAP[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1 if len(data) else np.zeros(0, np.int64)
    if len(data) and not gap[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    sums = np.concatenate([np.zeros(1, U), np.cumsum(_VALUE[data] * _power(_BASE, len(data)), dtype=U)])
    h = mixed((sums[end] - sums[start]) * _power(_UNDO, len(data) + 1)[start] + (end - start).astype(U))
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
    return h, np.searchsorted(ends, start, "right")


def shingle_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """The sorted different shingles of each text as int64; a text of fewer words is one
    shingle, one of none has no shingle."""
    for a, b in groups(texts):
        h, owner = word_hashes(texts[a:b])
        place = np.searchsorted(owner, np.arange(b - a + 1))
        n = max(0, len(h) - width + 1)
        total = np.zeros(n, U)
        for k in range(width):
            total += h[k : k + n] * U(_FACTOR[k])
        total = mixed(total)
        for i in range(b - a):
            lo, hi = int(place[i]), int(place[i + 1])
            if hi - lo >= width:
                yield np.unique(total[lo : hi - width + 1].view(np.int64))
            elif hi > lo:
                short = np.array([hi - lo], U)
                for k in range(lo, hi):
                    short = mixed(short * U(3) + h[k : k + 1])
                yield short.view(np.int64)
            else:
                yield np.zeros(0, np.int64)
