"""Compressed bitmaps over ordinals: sorted 16-bit arrays where sparse, bit sets of 8 KB where dense."""

from __future__ import annotations

import numpy as np

CHUNK = 1 << 16
#: A chunk with more members than this is kept as a bit set (its 8 KB are then the smaller form).
ARRAY_LIMIT = 4096


def _pack(members: np.ndarray) -> np.ndarray:
    """Sorted distinct uint16 -> the smaller of array and bit set."""
    if len(members) <= ARRAY_LIMIT:
        return members
    bits = np.zeros(CHUNK, np.bool_)
    bits[members] = True
    return np.packbits(bits)


def _members(c: np.ndarray) -> np.ndarray:
    return c if c.dtype == np.uint16 else np.flatnonzero(np.unpackbits(c)).astype(np.uint16)


def _and_not(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.dtype == np.uint8 and b.dtype == np.uint8:
        return _members(a & ~b)
    return np.setdiff1d(_members(a), _members(b), assume_unique=True)


def _and(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.dtype == np.uint8 and b.dtype == np.uint8:
        return _members(a & b)
    return np.intersect1d(_members(a), _members(b), assume_unique=True)


class Bitmap:
    """A set of non-negative integers as compressed chunks of 65,536."""

    def __init__(self, members=()):
        self.chunks: dict[int, np.ndarray] = {}
        m = np.unique(np.asarray(members, np.int64))
        high = m >> 16
        for h in np.unique(high):
            self.chunks[int(h)] = _pack((m[high == h] & 0xFFFF).astype(np.uint16))

    def _combine(self, other: Bitmap, how, keys) -> Bitmap:
        out = Bitmap()
        for k in keys:
            m = how(self.chunks[k], other.chunks[k]) if k in other.chunks else _members(self.chunks[k])
            if len(m):
                out.chunks[k] = _pack(m)
        return out

    def and_not(self, other: Bitmap) -> Bitmap:
        """Members of this one that the other lacks."""
        return self._combine(other, _and_not, self.chunks)

    def __and__(self, other: Bitmap) -> Bitmap:
        return self._combine(other, _and, self.chunks.keys() & other.chunks.keys())

    def __len__(self) -> int:
        return sum(len(_members(c)) for c in self.chunks.values())

    def to_array(self) -> np.ndarray:
        """Members in ascending order, as int64."""
        return np.concatenate([(k << 16) + _members(self.chunks[k]).astype(np.int64) for k in sorted(self.chunks)] or [np.zeros(0, np.int64)])

    def nbytes(self) -> int:
        return sum(c.nbytes for c in self.chunks.values())
