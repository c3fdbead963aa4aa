"""MinHash over 32-bit features: 64 minima, compressed to 256 bits."""

from __future__ import annotations

import numpy as np

from prismark.tables import MERSENNE, MINHASH_A, MINHASH_B

_A, _B, _P = np.array(MINHASH_A, dtype=np.uint64), np.array(MINHASH_B, dtype=np.uint64), np.uint64(MERSENNE)
_LOW = np.uint64(0xFFFFFFFF)
#: Features that go through all hash functions at a time: arrays of this size stay in a processor's cache.
STEP = 1 << 14


def lowest(features: np.ndarray, k: int, starts: np.ndarray, u: np.ndarray, top: np.ndarray) -> np.ndarray:
    """The minima, over runs of features, of ((a f + b) mod 2^64 mod 2^61 - 1), its low 32 bits, for hash function k.

    With u = a f + b mod 2^64, the remainder is u mod 2^61 plus u / 2^61, less 2^61 - 1 if it gets so large. Its low 32
    bits are those of u plus u / 2^61, but in the last case, which needs low bits of u next to 2^32: looked at anew.
    """
    np.multiply(features, _A[k], out=u)
    np.add(u, _B[k], out=u)
    np.right_shift(u, np.uint64(61), out=top)
    low = u.astype(np.uint32)
    if low.max() >= 0xFFFFFFF8:
        t = top + (u & _P)
        return np.minimum.reduceat((np.where(t >= _P, t - _P, t) & _LOW).astype(np.uint32), starts)
    low += top.astype(np.uint32)
    return np.minimum.reduceat(low, starts)


def minima(features: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(sets, 64): the minima of joined feature sets, none of them empty, that begin at ``starts``."""
    features = features.astype(np.uint64)
    out = np.full((64, len(starts)), 0xFFFFFFFF, dtype=np.uint32)
    ends = np.append(starts[1:], len(features))
    first = 0
    while first < len(starts):
        # As many whole sets as fit a step, or one longer set in parts.
        end = max(first + 1, int(np.searchsorted(ends, starts[first] + STEP, side="right")))
        low, high = int(starts[first]), int(ends[end - 1])
        size = STEP if end == first + 1 else high - low
        for at in range(low, high, size):
            part = features[at : min(at + size, high)]
            own = starts[first:end] - low if end > first + 1 else np.zeros(1, dtype=np.int64)
            u, top = np.empty_like(part), np.empty_like(part)
            for k in range(64):
                found = lowest(part, k, own, u, top)
                np.minimum(out[k, first:end], found, out=out[k, first:end])
        first = end
    return np.ascontiguousarray(out.T).astype(np.uint64)


def compressed(rows: np.ndarray, low_bits: int = 4) -> np.ndarray:
    """(sets, bytes): bit 0 of the 64 minima, then bit 1, and so on, first bit highest."""
    bits = np.concatenate([(rows >> np.uint64(k) & np.uint64(1)).astype(np.uint8) for k in range(low_bits)], axis=1)
    return np.packbits(bits, axis=1)


def digest(features: np.ndarray) -> bytes:
    """256 bits of one set; an empty one has all bits set."""
    rows = minima(features, np.zeros(1, dtype=np.int64)) if len(features) else np.full((1, 64), _LOW, dtype=np.uint64)
    return compressed(rows)[0].tobytes()
