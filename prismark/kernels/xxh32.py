"""XXH32 with seed 0: many short strings at once by arrays, long ones by the xxhash library where there is one."""

from __future__ import annotations

import numpy as np

try:
    from xxhash import xxh32_intdigest as _native
except ImportError:  # the array form does it all
    _native = None

# Fixed values of the hash's specification.
PRIMES = (2654435761, 2246822519, 3266489917, 668265263, 374761393)
P1, P2, P3, P4, P5 = (np.uint32(p) for p in PRIMES)


#: Bytes beyond which a string is hashed by itself.
LONG = 64


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return x << np.uint32(n) | x >> np.uint32(32 - n)


def of_equal(rows: np.ndarray) -> np.ndarray:
    """Hashes of the rows of a (strings, bytes) array."""
    n, size = rows.shape
    whole = size // 4
    words = np.ascontiguousarray(rows[:, : 4 * whole]).view("<u4").reshape(n, whole)
    with np.errstate(over="ignore"):
        at = 0
        if size >= 16:
            lanes = [np.full(n, v, dtype=np.uint32) for v in ((PRIMES[0] + PRIMES[1]) % 2**32, PRIMES[1], 0, -PRIMES[0] % 2**32)]
            while at + 4 <= whole:
                lanes = [_turn(v + words[:, at + k] * P2, 13) * P1 for k, v in enumerate(lanes)]
                at += 4
            h = sum((_turn(v, k) for v, k in zip(lanes[1:], (7, 12, 18), strict=True)), _turn(lanes[0], 1))
        else:
            h = np.full(n, P5, dtype=np.uint32)
        h = h + np.uint32(size)
        for k in range(at, whole):
            h = _turn(h + words[:, k] * P3, 17) * P4
        for k in range(4 * whole, size):
            h = _turn(h + rows[:, k].astype(np.uint32) * P5, 11) * P1
        h = (h ^ h >> np.uint32(15)) * P2
        h = (h ^ h >> np.uint32(13)) * P3
    return h ^ h >> np.uint32(16)


def of_spans(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of spans of a byte array; short spans of one length go together."""
    out = np.zeros(len(starts), dtype=np.uint32)
    long = sizes > LONG if _native else np.zeros(len(sizes), dtype=bool)
    if long.any():
        raw = data.tobytes()
        for k in np.flatnonzero(long):
            out[k] = _native(raw[starts[k] : starts[k] + sizes[k]])
    for size in np.unique(sizes[~long]):
        some = np.flatnonzero(sizes == size)
        out[some] = of_equal(data[starts[some][:, None] + np.arange(size)] if size else np.zeros((len(some), 0), np.uint8))
    return out


def of(data: bytes) -> int:
    return _native(data) if _native else int(of_equal(np.frombuffer(data, dtype=np.uint8).reshape(1, -1))[0])
