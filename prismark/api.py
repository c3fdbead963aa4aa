"""The generators and utilities for single values, without Spark: what a notebook or a service calls.

Results are dictionaries whose keys are attributes too; keys without a value are absent. Invalid input raises
``ValueError``. Bytes may be ``bytes``, ``bytearray``, ``memoryview`` or an object with ``read``.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from types import SimpleNamespace
from typing import Any

import numpy as np

from prismark import tables
from prismark.kernels import cdc, codec, codes, dct, jcs, minhash, sequences, simhash, text
from prismark.kernels.codes import DataHasher as _DataHasher
from prismark.kernels.codes import InstanceHasher as _InstanceHasher
from prismark.tables import MainType as MT
from prismark.tables import SubType as ST
from prismark.tables import Version as VS

__all__ = [
    "MT", "ST", "VS", "DataHasher", "InstanceHasher", "Result", "alg_cdc_chunks", "alg_dct", "alg_minhash_256", "alg_simhash", "alg_wtahash", "conformance_selftest", "core_opts", "encode_base64", "encode_component",
    "gen_audio_code_v0", "gen_data_code_v0", "gen_image_code_v0", "gen_instance_code_v0", "gen_iscc_code_v0", "gen_meta_code_v0", "gen_mixed_code_v0", "gen_sum_code_v0", "gen_text_code_v0", "gen_video_code_v0",
    "iscc_decode", "iscc_decompose", "json_to_data_url", "sliding_window", "soft_hash_codes_v0", "soft_hash_video_v0", "text_clean", "text_collapse", "text_remove_newlines", "text_trim",
]

core_opts = SimpleNamespace(meta_trim_name=tables.TRIM_NAME, meta_trim_description=tables.TRIM_DESCRIPTION, meta_trim_meta=tables.TRIM_META, io_read_size=tables.READ_SIZE, text_ngram_size=tables.TEXT_NGRAM)

text_clean, text_collapse, text_remove_newlines, text_trim, sliding_window = text.clean, text.collapse, text.remove_newlines, text.trim, text.ngrams
alg_simhash, alg_wtahash, soft_hash_codes_v0 = simhash.simhash, sequences.winners, codes.mixed_digest
soft_hash_video_v0, json_to_data_url = sequences.video_digest, jcs.json_url
encode_base64, iscc_decompose = codec.base64_url, codec.decomposed


class Result(dict):
    """A dictionary with its keys as attributes."""

    def __getattr__(self, name: str) -> Any:
        if name in self:
            return self.get(name)
        raise AttributeError(f"this result has no {name}")


def _result(found: dict) -> Result:
    return Result({k: v for k, v in found.items() if v is not None})


def _bytes(data: Any) -> bytes:
    return data.read() if hasattr(data, "read") else bytes(data)


def alg_minhash_256(features: Sequence[int]) -> bytes:
    return minhash.digest(np.array(features, dtype=np.uint64))


def alg_dct(values: Sequence[float]) -> list[float]:
    return dct.dct(np.array(values, dtype=np.float64)).tolist()


def alg_cdc_chunks(data: Any, utf32: bool = False, avg_chunk_size: int = tables.CHUNK_SIZE) -> list[bytes]:
    return cdc.split(_bytes(data), utf32, avg_chunk_size)


def encode_component(mtype: int, stype: int, version: int, bit_length: int, digest: bytes) -> str:
    return codec.component(mtype, stype, version, bit_length, bytes(digest))


def iscc_decode(code: str) -> tuple[MT, ST, VS, int, bytes]:
    mtype, stype, version, length, digest = codec.decoded(code)
    return MT(mtype), ST(stype), VS(version), length, digest


def gen_meta_code_v0(name: str, description: str | None = None, meta: str | dict | None = None, bits: int = 64) -> Result:
    if isinstance(meta, dict):
        meta = jcs.json_url(json.dumps(meta, ensure_ascii=False, separators=(",", ":")))
    return _result(codes.meta_code(name, description, meta, bits))


def gen_text_code_v0(text: str, bits: int = 64) -> Result:
    return _result(codes.text_codes([text], bits)[0])


def gen_image_code_v0(pixels: Any, bits: int = 64) -> Result:
    return _result(codes.image_code(_bytes(pixels), bits))


def gen_audio_code_v0(cv: Sequence[int], bits: int = 64) -> Result:
    return _result(codes.audio_code(cv, bits))


def gen_video_code_v0(frame_sigs: Sequence[Sequence[int]], bits: int = 64) -> Result:
    return _result(codes.video_code(list(frame_sigs), bits))


def gen_mixed_code_v0(units: Sequence[str], bits: int = 64) -> Result:
    return _result(codes.mixed_code(list(units), bits))


def gen_data_code_v0(data: Any, bits: int = 64) -> Result:
    return _stream(DataHasher(), data).finalize(bits) if hasattr(data, "read") else _result(codes.data_code(_bytes(data), bits))


def gen_instance_code_v0(data: Any, bits: int = 64) -> Result:
    return _stream(InstanceHasher(), data).finalize(bits) if hasattr(data, "read") else _result(codes.instance_code(_bytes(data), bits))


def gen_iscc_code_v0(units: Sequence[str], wide: bool = False) -> Result:
    return _result(codes.iscc_code(list(units), wide))


def gen_sum_code_v0(path: Any, bits: int = 64, wide: bool = False, add_units: bool = False) -> Result:
    """Of a file, read once in blocks."""
    hashers = DataHasher(), InstanceHasher()
    try:
        f = open(path, "rb")  # noqa: SIM115
    except OSError as e:
        raise ValueError(f"Cannot open file {path}: {e}") from None
    with f:
        while block := _block(f, path):
            for h in hashers:
                h.update(block)
    data, instance = (h.finalize(bits) for h in hashers)
    units = [data.iscc, instance.iscc]
    return _result({"iscc": codec.composed(units, wide), "datahash": instance.datahash, "filesize": instance.filesize, "units": units if add_units else None})


def _block(f: Any, path: Any) -> bytes:
    try:
        return f.read(tables.READ_SIZE)
    except OSError as e:
        raise ValueError(f"Cannot read file {path}: {e}") from None


class DataHasher(_DataHasher):
    """``update`` takes bytes or an object with ``read``."""

    def update(self, data: Any) -> None:
        _stream(super(), data) if hasattr(data, "read") else super().update(_bytes(data))

    def finalize(self, bits: int = 64) -> Result:
        return _result(super().finalize(bits))


class InstanceHasher(_InstanceHasher):
    """``update`` takes bytes or an object with ``read``."""

    def update(self, data: Any) -> None:
        _stream(super(), data) if hasattr(data, "read") else super().update(_bytes(data))

    def finalize(self, bits: int = 64) -> Result:
        return _result(super().finalize(bits))


def _stream(hasher: Any, data: Any) -> Any:
    while block := data.read(tables.READ_SIZE):
        hasher.update(block)
    return hasher


def conformance_selftest() -> bool:
    """Known answers of the kernels; never raises."""
    try:
        return (
            gen_meta_code_v0("Die Unendliche Geschichte", "Von Michael Ende").iscc == "ISCC:AAAZXZ6OU4E45RB5"
            and gen_text_code_v0("Hello World") == {"iscc": "ISCC:EAASKDNZNYGUUF5A", "characters": 10}
            and gen_image_code_v0(b"\xff" * 1024, 128).iscc == "ISCC:EEBYAAAAAAAAAAAAAAAAAAAAAAAAA"
            and gen_audio_code_v0([1], 128).iscc == "ISCC:EIBQAAAAAEAAAAABAAAAAAAAAAAAA"
            and gen_video_code_v0([[0] * tables.FRAME]).iscc == "ISCC:EMAQAAAAAAAAAAAA"
            and len(gen_mixed_code_v0(["EUA6GIKXN42IQV3S", "EIAUKMOUIOYZCKA5"]).parts) == 2
            and gen_data_code_v0(b"\xff\x00").iscc == "ISCC:GAAXL2XYM5BQIAZ3"
            and gen_instance_code_v0(b"").iscc == "ISCC:IAA26E2JXH27TING"
            and gen_iscc_code_v0(["GAAXL2XYM5BQIAZ3", "IAA26E2JXH27TING"]).iscc.startswith("ISCC:KUA")
        )
    except Exception:  # noqa: BLE001
        return False
