"""N-grams are generate and explode, MinHash is 64 minima, SimHash is sums of bits, tiles are windows.

Minima and sums have partial aggregates, so a key with very many rows is reduced before the shuffle. Windows need a key's
rows together; they are for assets of bounded length (an audio fingerprint), not for corpora.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismark import functions as P
from prismark.tables import MERSENNE, MINHASH_A, MINHASH_B, frame_pairs

_LOW = (1 << 32) - 1


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ngram_rows(df: DataFrame, text: str, width: int, *keep: str) -> DataFrame:
    """The kept columns, ``pos`` and ``gram``: a row for each n-gram."""
    return df.select(*keep, F.posexplode(P.sliding_window(text, width)).alias("pos", "gram"))


def chunk_rows(df: DataFrame, data: str, *keep: str, average: int = 1024) -> DataFrame:
    """The kept columns, ``seq`` and ``chunk``: a row for each content-defined chunk."""
    return df.select(*keep, F.posexplode(P.cdc_chunks(data, average=average)).alias("seq", "chunk"))


def decompose_rows(df: DataFrame, code: str, *keep: str) -> DataFrame:
    """The kept columns, ``pos`` and ``unit``: a row for each unit of a composite."""
    return df.select(*keep, F.posexplode(P.decompose(code)).alias("pos", "unit"))


def _permuted(f: Column, a: int, b: int) -> Column:
    """((a f + b) mod 2^64 mod 2^61 - 1), its low 32 bits, for 0 <= f < 2^32.

    In limbs of 32 bits, so that nothing overflows a bigint: the same under ANSI arithmetic and without.
    """
    low, high = a & _LOW, a >> 32
    p, q = F.lit(low) * f.bitwiseAND(F.lit(0xFFFF)), F.lit(low) * F.shiftright(f, 16)
    t = p.bitwiseAND(F.lit(_LOW)) + F.shiftleft(q.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(b & _LOW)
    top = (F.shiftright(p, 32) + F.shiftright(q, 16) + F.lit(high) * f + F.lit(b >> 32) + F.shiftright(t, 32)).bitwiseAND(F.lit(_LOW))
    t = F.shiftright(top, 29) + F.shiftleft(top.bitwiseAND(F.lit((1 << 29) - 1)), 32) + t.bitwiseAND(F.lit(_LOW))
    return (t % F.lit(MERSENNE)).bitwiseAND(F.lit(_LOW))  # told once: the generated code holds each use of t anew


def minhash_columns(feature: Column | str) -> list[Column]:
    """64 aggregates: the minima of a feature's hash functions, 2^32 - 1 where there is no feature."""
    f = _col(feature).cast("bigint")
    return [F.coalesce(F.min(_permuted(f, a, b)), F.lit(_LOW)).alias(f"m{k}") for k, (a, b) in enumerate(zip(MINHASH_A, MINHASH_B, strict=True))]


def packed_bits(bits: list[Column]) -> Column:
    """0/1 columns as a binary, first highest."""
    out = []
    for k in range(0, len(bits), 32):
        part = bits[k : k + 32]
        word = F.lit(0).cast("bigint")
        for n, b in enumerate(part):
            word = word + F.shiftleft(b.cast("bigint"), len(part) - 1 - n)
        out.append(F.lpad(F.hex(word), len(part) // 4, "0"))
    return F.unhex(F.concat(*out))


def minhash_digests(df: DataFrame, feature: str, *keys: str) -> DataFrame:
    """The keys and ``digest``: 256 bits of each key's set of 32-bit features."""
    rows = df.groupBy(*keys).agg(*minhash_columns(feature))
    return rows.select(*keys, packed_bits([F.shiftright(f"m{m}", k).bitwiseAND(F.lit(1)) for k in range(4) for m in range(64)]).alias("digest"))


def simhash_digests(df: DataFrame, word: str, *keys: str, bits: int = 32) -> DataFrame:
    """The keys and ``digest``: the majority of each bit of integers of ``bits`` bits (two's complement); ties set it."""
    w = F.col(word).cast("bigint")
    sums = [F.sum(F.shiftright(w, bits - 1 - k).bitwiseAND(F.lit(1))).alias(f"b{k}") for k in range(bits)]
    rows = df.groupBy(*keys).agg(*sums, F.count(w).alias("n"))
    return rows.select(*keys, packed_bits([(2 * F.col(f"b{k}") >= F.col("n")).cast("int") for k in range(bits)]).alias("digest"))


def split_parts(df: DataFrame, n: int, order: list[str], *keys: str, name: str = "part") -> DataFrame:
    """``df`` with the number (from 1) of the row's part, of n in order, the first ones longer by one."""
    return df.withColumn(name, F.ntile(n).over(Window.partitionBy(*keys).orderBy(*order)))


def audio_digests(df: DataFrame, value: str, position: str, *keys: str) -> DataFrame:
    """The keys and ``digest``: 32 bytes of each key's signed 32-bit features: all, quarters in order, thirds by value."""
    tiles = split_parts(split_parts(df, 4, [position], *keys, name="quarter"), 3, [value, position], *keys, name="third")
    v = F.col(value).cast("bigint")
    stages = [F.lit(True), *[F.col("quarter") == k for k in range(1, 5)], *[F.col("third") == k for k in range(1, 4)]]
    sums = [F.sum(F.when(on, F.shiftright(v, 31 - k).bitwiseAND(F.lit(1)))).alias(f"s{s}_{k}") for s, on in enumerate(stages) for k in range(32)]
    rows = tiles.groupBy(*keys).agg(*sums, *[F.count(F.when(on, v)).alias(f"n{s}") for s, on in enumerate(stages)])
    bits = [((2 * F.coalesce(f"s{s}_{k}", F.lit(0)) >= F.col(f"n{s}")) & (F.col(f"n{s}") > 0)).cast("int") for s in range(len(stages)) for k in range(32)]
    return rows.select(*keys, packed_bits(bits).alias("digest"))


def column_sums(frames: Column | str) -> Column:
    """The sum of distinct frames, place by place, as an array of bigints."""
    unique = F.array_distinct(_col(frames))
    zero = F.transform(F.element_at(unique, 1), lambda _: F.lit(0).cast("bigint"))
    return F.aggregate(unique, zero, lambda total, frame: F.zip_with(total, frame, lambda a, b: a + b.cast("bigint")))


def winner_bits(vector: Column | str, bits: int = 64) -> Column:
    """Of a vector: a bit for each of the first pairs of places, set if the second holds the larger number."""
    v = _col(vector)
    return packed_bits([(F.element_at(v, i + 1) < F.element_at(v, j + 1)).cast("int") for i, j in frame_pairs()[:bits]])


def video_digest_native(df: DataFrame, frames: str, *keep: str, bits: int = 64) -> DataFrame:
    """The kept columns and ``digest`` of an array of frame signatures."""
    return df.select(*keep, column_sums(frames).alias("__v")).select(*keep, winner_bits("__v", bits).alias("digest"))


def interleaved(a: Column | str, b: Column | str) -> Column:
    """The first 16 bytes of two digests, four of each in turn."""
    return F.concat(*[F.substring(_col(c), k, 4) for k in (1, 5, 9, 13) for c in (a, b)])
