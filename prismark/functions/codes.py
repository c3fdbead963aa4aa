"""Generators and their primitives as columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from prismark.functions.arrow import column
from prismark.kernels import blake3, cdc, codes, jcs, minhash, sequences
from prismark.kernels import dct as dct_kernel
from prismark.kernels import simhash as simhash_kernel
from prismark.kernels import xxh32 as xxh32_kernel

ISCC = "struct<iscc:string>"
TEXT = "struct<iscc:string,characters:bigint>"
META = "struct<iscc:string,name:string,description:string,meta:string,metahash:string>"
MIXED = "struct<iscc:string,parts:array<string>>"
INSTANCE = "struct<iscc:string,datahash:string,filesize:bigint>"
SUM = "struct<iscc:string,datahash:string,filesize:bigint,units:array<string>>"


def _or_null(c: Column | str | None) -> Column:
    return F.lit(None).cast("string") if c is None else F.col(c) if isinstance(c, str) else c


def meta_code(name, description=None, meta=None, bits: int = 64) -> Column:
    return column(codes.meta_codes, META, name, _or_null(description), _or_null(meta), bits=bits, batch=True)


def try_meta_code(name, description=None, meta=None, bits: int = 64) -> Column:
    return column(codes.meta_codes, META, name, _or_null(description), _or_null(meta), bits=bits, batch=True, lenient=True)


def text_code(text, bits: int = 64) -> Column:
    """All texts of a slice go through the hash functions together."""
    return column(codes.text_codes, TEXT, text, bits=bits, batch=True)


def _text_features(collapsed: str) -> list[int]:
    data, starts, sizes, _ = codes.gram_spans([codes.encoded(collapsed)], codes.TEXT_NGRAM)
    return xxh32_kernel.of_spans(data, starts, sizes).astype(np.int64).tolist()


def text_features(collapsed) -> Column:
    """XXH32 of the 13-character n-grams of a collapsed text."""
    return column(_text_features, "array<bigint>", collapsed)


def image_code(pixels, bits: int = 64) -> Column:
    return column(codes.image_codes, ISCC, pixels, bits=bits, batch=True)


def try_image_code(pixels, bits: int = 64) -> Column:
    return column(codes.image_codes, ISCC, pixels, bits=bits, batch=True, lenient=True)


def audio_code(features, bits: int = 64) -> Column:
    return column(codes.audio_code, ISCC, features, bits=bits)


def try_audio_code(features, bits: int = 64) -> Column:
    return column(codes.audio_code, ISCC, features, bits=bits, lenient=True)


def video_code(frames, bits: int = 64) -> Column:
    return column(codes.video_code, ISCC, frames, bits=bits)


def try_video_code(frames, bits: int = 64) -> Column:
    return column(codes.video_code, ISCC, frames, bits=bits, lenient=True)


def video_digest(frames, bits: int = 64) -> Column:
    return column(sequences.video_digest, "binary", frames, bits=bits)


def frame_buffer_code(data, frames: int, length: int, bits: int = 64) -> Column:
    """Video code of frames that lie one after another in a binary column, as little-endian 32-bit integers."""
    return column(_frame_buffer_code, ISCC, data, frames=frames, length=length, bits=bits)


def _frame_buffer_code(data: bytes, frames: int, length: int, bits: int) -> dict:
    if len(data) != 4 * frames * length:
        raise ValueError(f"expected {4 * frames * length} bytes of frames, got {len(data)}")
    return codes.video_code(list(np.frombuffer(data, dtype="<i4").reshape(frames, length)), bits)


def mixed_code(units, bits: int = 64) -> Column:
    return column(codes.mixed_code, MIXED, units, bits=bits)


def try_mixed_code(units, bits: int = 64) -> Column:
    return column(codes.mixed_code, MIXED, units, bits=bits, lenient=True)


def data_code(data, bits: int = 64) -> Column:
    return column(codes.data_codes, ISCC, data, bits=bits, batch=True)


def instance_code(data, bits: int = 64) -> Column:
    return column(codes.instance_codes, INSTANCE, data, bits=bits, batch=True)


def sum_code(data, bits: int = 64, wide: bool = False, units: bool = False) -> Column:
    """Data, instance and composite code from one pass of the bytes to Python."""
    return column(codes.sum_codes, SUM, data, bits=bits, wide=wide, units=units, batch=True)


def stream_bytes(text) -> Column:
    """Native: the bytes that published test vectors spell as ``stream:<hexadecimal digits>``; null for other strings."""
    c = F.col(text) if isinstance(text, str) else text
    return F.when(c.startswith("stream:"), F.unhex(F.substr(c, F.lit(8))))


def xxh32(data) -> Column:
    return column(xxh32_kernel.of, "bigint", data)


def multihash(data) -> Column:
    """BLAKE3 as hexadecimal multihash."""
    return column(codes.multihashes, "string", data, batch=True)


def blake3_digest(data) -> Column:
    return column(blake3.digests, "binary", data, batch=True)


def cdc_chunks(data, utf32: bool = False, average: int = 1024) -> Column:
    return column(cdc.split, "array<binary>", data, utf32=utf32, average=average)


def simhash(digests) -> Column:
    return column(simhash_kernel.simhash, "binary", digests)


def _minhash(features: list[int]) -> bytes:
    return minhash.digest(np.array(features, dtype=np.uint64))


def minhash_256(features) -> Column:
    return column(_minhash, "binary", features)


def wta_hash(vector, bits: int = 64) -> Column:
    return column(sequences.winners, "binary", vector, bits=bits)


def _dct(values: list[float]) -> list[float]:
    return dct_kernel.dct(np.array(values, dtype=np.float64)).tolist()


def dct(values) -> Column:
    return column(_dct, "array<double>", values)


def json_data_url(text) -> Column:
    return column(jcs.json_url, "string", text)


def try_json_data_url(text) -> Column:
    return column(jcs.json_url, "string", text, lenient=True)


def try_data_url_bytes(url) -> Column:
    """The payload of a data URL, null if it isn't one."""
    return column(jcs.payload, "binary", url, lenient=True)
