"""Content-defined chunks by a gear rolling hash."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from prismark.tables import CHUNK_SIZE, gear

#: Bytes after a chunk's least size that are walked one by one: beyond, the hash has forgotten where it began.
WALKED = 64
#: A looked-up hash is exact but for carries out of its 32 bits of fraction; so near to an integer it is computed anew.
DOUBT = np.uint64(32)


@dataclass(frozen=True)
class Sizes:
    """Derived from the average: least and greatest size, where the strict mask ends, and both masks."""

    least: int
    most: int
    centre: int
    strict: int
    loose: int

    @classmethod
    def of(cls, average: int) -> Sizes:
        if average < 2:
            raise ValueError(f"avg_chunk_size must be >= 2, got {average}")
        least = average // 4
        bits = int(math.floor(math.log2(average) + 0.5))
        return cls(least, average * 8, average - (least + -(-least // 2)), (1 << bits + 1) - 1, (1 << bits - 1) - 1)


def running(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte as if it had run from the start, with 32 bits of fraction.

    h_n = floor(h_{n-1} / 2) + g_n, and floors of halves nest, so h_n is the floor of the sum of g_{n-k} / 2^k. The sum of
    2m terms is that of m terms plus the one m places before, divided by 2^m: six steps give 64 terms.
    """
    out = table.astype(np.uint64)[data] << np.uint64(32)
    for m in (1, 2, 4, 8, 16, 32):
        if m < len(out):
            out[m:] = out[m:] + (out[:-m] >> np.uint64(m))
    return out


def cut(data: np.ndarray, hashes: np.ndarray, at: int, sizes: Sizes, table: list[int]) -> int:
    """The end of the chunk that begins at ``at``: one past the first byte whose hash the mask passes."""
    size = len(data) - at
    start, middle, end = (min(x, size) for x in (sizes.least, sizes.centre, sizes.most))
    pattern, i, walk = 0, start, min(start + WALKED, end)
    for n, b in enumerate(data[at + start : at + walk].tolist(), start):
        pattern = (pattern >> 1) + table[b]
        if not pattern & (sizes.strict if n < middle else sizes.loose):
            return at + n + 1
    i = max(walk, start)
    for stop, mask in ((middle, sizes.strict), (end, sizes.loose)):
        while i < stop:
            part = hashes[at + i : min(at + i + 2048, at + stop)]
            fraction = part & np.uint64(0xFFFFFFFF)
            doubt = (fraction + DOUBT & np.uint64(0xFFFFFFFF)) < 2 * DOUBT
            for k in np.flatnonzero((part >> np.uint64(32) & np.uint64(mask) == 0) | doubt).tolist():
                if not doubt[k] or walked(data[at + start : at + i + k + 1], table) & mask == 0:
                    return at + i + k + 1
            i += len(part)
    return at + i


def walked(data: np.ndarray, table: list[int]) -> int:
    """The hash of a run, byte by byte."""
    pattern = 0
    for b in data.tolist():
        pattern = (pattern >> 1) + table[b]
    return pattern


def cuts(data: bytes, utf32: bool = False, average: int = CHUNK_SIZE, table: np.ndarray | None = None) -> list[int]:
    """The ends of all chunks; an empty string has one, at 0."""
    sizes, table = Sizes.of(average), gear() if table is None else table
    if not data:
        return [0]
    values, numbers = np.frombuffer(data, dtype=np.uint8), table.tolist()
    hashes = running(values, table)
    out, at = [], 0
    while at < len(data):
        end = cut(values, hashes, at, sizes, numbers)
        if utf32:
            end -= (end - at) % 4
            if end == at:
                end = min(at + 4, len(data))
        out.append(end)
        at = end
    return out


def split(data: bytes, utf32: bool = False, average: int = CHUNK_SIZE, table: np.ndarray | None = None) -> list[bytes]:
    """The chunks; joined they are the string."""
    ends = cuts(data, utf32, average, table)
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
