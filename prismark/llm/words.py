"""Hashes of words: all words of a slice of texts at once, as arrays, with nothing kept from one slice to the next.

Words part at ASCII white space (space, and tab to carriage return); A-Z count as a-z. A word's hash takes its length and
its bytes, eight at a time, so a word of any length is hashed whole.
"""

from __future__ import annotations

import numpy as np

LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
#: The bytes of an eight-byte number that a word's last n bytes fill.
FILLED = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
FACTOR, START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ x >> np.uint64(33)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all texts' words in their order, and how many words each text has."""
    data = LOWER[np.frombuffer(b" " + b" ".join(texts) + b" " * 9, dtype=np.uint8)]
    inside = ~SPACE[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    at, ends = edges[::2], edges[1::2]
    left = ends - at
    eight = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    out = left.astype(np.uint64) * START
    h, of = out, slice(None)
    while True:
        h = (h ^ (eight[at] & FILLED[np.minimum(left, 8)])) * FACTOR
        h ^= h >> np.uint64(32)
        out[of] = h
        more = np.flatnonzero(left > 8)
        if not len(more):
            break
        of = more if isinstance(of, slice) else of[more]
        at, left, h = at[more] + 8, left[more] - 8, h[more]
    starts = np.cumsum([1] + [len(t) + 1 for t in texts])
    return mixed(out), np.diff(np.searchsorted(edges[::2], starts))
