"""Relational forms of the algorithms: explode, partial and final aggregates, windows. All native."""

from prismark.operators.relational import (
    audio_digests, chunk_rows, column_sums, decompose_rows, interleaved, minhash_columns, minhash_digests, ngram_rows, packed_bits, simhash_digests, split_parts, video_digest_native, winner_bits,
)

__all__ = [n for n in dir() if not n.startswith("_") and n != "relational"]
