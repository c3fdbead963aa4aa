"""The image hash: a discrete cosine transform of 32 x 32 grey pixels, block medians and their bits."""

from __future__ import annotations

import math

import numpy as np

# Fixed value: where the hash's four 8 x 8 blocks begin, as (column, row).
BLOCKS = ((0, 0), (1, 0), (0, 1), (1, 1))


def dct(rows: np.ndarray) -> np.ndarray:
    """Unscaled DCT-II along the last axis, whose length is a power of two, by halving into sums and differences.

    The order of operations decides the last bits, and those decide ties against a median, so it is fixed: difference,
    divided by the cosine, divided by two.
    """
    n = rows.shape[-1]
    if n == 0 or n & n - 1:
        raise ValueError(f"DCT input length must be a power of 2, got {n}")
    if n == 1:
        return rows.astype(np.float64)
    half = n // 2
    front, back = rows[..., :half].astype(np.float64), rows[..., : half - 1 : -1].astype(np.float64)
    cosines = np.array([math.cos((i + 0.5) * math.pi / n) for i in range(half)])
    even, odd = dct(front + back), dct((front - back) / cosines / 2.0)
    out = np.empty(rows.shape, dtype=np.float64)
    out[..., 0::2] = even
    out[..., 1:-1:2] = odd[..., :-1] + odd[..., 1:]
    out[..., -1] = odd[..., -1]
    return out


def image_bits(pixels: np.ndarray) -> np.ndarray:
    """(pictures, 256) bits of (pictures, 1024) grey pixels: coefficients above their block's median."""
    grid = dct(pixels.reshape(-1, 32, 32))
    grid = dct(grid.transpose(0, 2, 1)).transpose(0, 2, 1)
    flat = [grid[:, r : r + 8, c : c + 8].reshape(-1, 64) for c, r in BLOCKS]
    return np.concatenate([(f > np.median(f, axis=1)[:, None]).astype(np.uint8) for f in flat], axis=1)


def image_digests(pictures: list[bytes], bits: int) -> list[bytes | ValueError]:
    """Of pictures of 1024 bytes; an error in the place of one that isn't."""
    if bits > 256:
        raise ValueError(f"bits must be <= 256, got {bits}")
    good = [k for k, p in enumerate(pictures) if len(p) == 1024]
    out: list = [ValueError(f"expected 1024 pixels, got {len(p)}") for p in pictures]
    if good:
        found = image_bits(np.frombuffer(b"".join([bytes(pictures[k]) for k in good]), dtype=np.uint8).reshape(-1, 1024))
        for k, row in zip(good, np.packbits(found[:, :bits], axis=1), strict=True):
            out[k] = row.tobytes()
    return out
