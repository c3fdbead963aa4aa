"""SimHash: the majority of each bit over digests of one width."""

from __future__ import annotations

import numpy as np


def majority(digests: np.ndarray) -> np.ndarray:
    """Bytes of a (digests, bytes) array's majority; a tie sets the bit."""
    counts = np.unpackbits(digests, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts >= len(digests))


def majorities(digests: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(groups, bytes) of joined digests whose groups, none of them empty, begin at ``starts``."""
    counts = np.add.reduceat(np.unpackbits(digests, axis=1), starts, axis=0, dtype=np.int64)
    sizes = np.diff(np.append(starts, len(digests)))
    return np.packbits(2 * counts >= sizes[:, None], axis=1)


def simhash(digests: list[bytes]) -> bytes:
    """Of a list; none gives 32 zero bytes, different widths are an error."""
    if not digests:
        return bytes(32)
    if len({len(d) for d in digests}) > 1:
        raise ValueError("all digests must have equal length")
    return majority(np.frombuffer(b"".join(digests), dtype=np.uint8).reshape(len(digests), -1)).tobytes()
