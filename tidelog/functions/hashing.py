"""128-bit MurmurHash3 (x64) of byte strings, for Bloom filters whose bits must match other writers of the format.

Many keys are hashed at once: keys of equal numbers of 16-byte blocks form a matrix of 64-bit words, and each column of words
is mixed in for all of them together.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

# The published multipliers, addends and rotations of the hash.
_C1, _C2 = np.uint64(0x87C37B91114253D5), np.uint64(0x4CF5AD432745937F)
_ADD1, _ADD2 = np.uint64(0x52DCE729), np.uint64(0x38495AB5)
_F1, _F2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_FIVE, _33 = np.uint64(5), np.uint64(33)


def _rotate(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def _finish(x: np.ndarray) -> np.ndarray:
    for factor in (_F1, _F2):
        x = (x ^ x >> _33) * factor
    return x ^ x >> _33


def _same_blocks(keys: list[bytes], full: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Halves of the hashes of keys that all have `full` whole blocks of 16 bytes."""
    width = 16 * full + 16
    words = np.frombuffer(b"".join(k.ljust(width, b"\0") for k in keys), "<u8").reshape(len(keys), -1).astype(np.uint64)
    a = np.full(len(keys), seed, np.uint64)
    b = a.copy()
    for at in range(0, 2 * full + 2, 2):
        whole = at < 2 * full
        a ^= _rotate(words[:, at] * _C1, 31) * _C2
        if whole:
            a = (_rotate(a, 27) + b) * _FIVE + _ADD1
        b ^= _rotate(words[:, at + 1] * _C2, 33) * _C1
        if whole:
            b = (_rotate(b, 31) + a) * _FIVE + _ADD2
    length = np.fromiter(map(len, keys), np.uint64, len(keys))
    a, b = a ^ length, b ^ length
    a = a + b
    b = b + a
    a, b = _finish(a), _finish(b)
    a = a + b
    return a, b + a


def murmur128_many(keys: Sequence[bytes], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of each key's hash as unsigned 64-bit integers."""
    a, b = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint64)
    blocks = np.fromiter((len(k) // 16 for k in keys), np.int64, len(keys))
    for full in np.unique(blocks):
        rows = np.flatnonzero(blocks == full)
        a[rows], b[rows] = _same_blocks([keys[i] for i in rows], int(full), seed)
    return a, b


def murmur128(data: bytes, seed: int = 0) -> tuple[int, int]:
    """Both halves as unsigned integers."""
    a, b = murmur128_many([data], seed)
    return int(a[0]), int(b[0])
