"""Hashes of feature sequences: audio (staged SimHash) and video (winner takes all)."""

from __future__ import annotations

import numpy as np

from prismark.kernels.simhash import majority
from prismark.tables import FRAME, frame_pairs


def parts(values: np.ndarray, n: int) -> list[np.ndarray]:
    """n parts in order, the first ones longer by one; some may be empty."""
    return np.array_split(values, n)


def audio_digest(values: np.ndarray) -> bytes:
    """32 bytes of a vector of signed 32-bit features: all, quarters in order, thirds by value."""
    if not len(values):
        return bytes(32)
    values = np.asarray(values, dtype=np.int32)
    of = lambda v: majority(np.ascontiguousarray(v.astype(">i4")).view(np.uint8).reshape(-1, 4)).tobytes() if len(v) else bytes(4)
    return b"".join([of(values), *map(of, parts(values, 4)), *map(of, parts(np.sort(values), 3))])


def winners(vector: np.ndarray, bits: int) -> bytes:
    """A bit for each of the first ``bits`` pairs of places: the second holds the larger number."""
    if len(vector) < FRAME:
        raise ValueError(f"WTA-Hash input must have at least {FRAME} elements, got {len(vector)}")
    if bits <= 0 or bits % 8 or bits > 256:
        raise ValueError(f"WTA-Hash bits must be > 0, divisible by 8, and ≤ 256, got {bits}")
    left, right = np.array(frame_pairs()[:bits]).T
    vector = np.asarray(vector, dtype=np.int64)
    return np.packbits(vector[left] < vector[right]).tobytes()


def video_digest(frames: list, bits: int) -> bytes:
    """Of frame signatures: distinct ones, summed by place."""
    if not len(frames):
        raise ValueError("frame_sigs must not be empty")
    if len({len(f) for f in frames}) > 1 or not len(frames[0]):
        raise ValueError("frame signatures must have one length, above 0")
    return winners(np.unique(np.asarray(frames, dtype=np.int64), axis=0).sum(axis=0), bits)
