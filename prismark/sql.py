"""The functions under SQL names: ``register(spark)``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from prismark.functions.arrow import _made
from prismark.functions.codec import DECODED, _decoded
from prismark.functions.codes import INSTANCE, ISCC, META, MIXED, SUM, TEXT
from prismark.kernels import cdc, codec, codes, jcs, text
from prismark.sources import ChunkedFiles


def _meta_rows(rows: list[tuple]) -> list:
    """Meta codes of (name, description, metadata, bits); descriptions and metadata may be null."""
    out: list = [None] * len(rows)
    for bits in {r[3] for r in rows}:
        some = [i for i, r in enumerate(rows) if r[3] == bits]
        for i, x in zip(some, codes.meta_codes([rows[i][:3] for i in some], 64 if bits is None else bits), strict=True):
            out[i] = x
    return out


#: SQL name: kernel, result, whether it takes batches, number of arguments.
FUNCTIONS = {
    "text_clean": (text.clean, "string", False, 1), "text_collapse": (text.collapse, "string", False, 1), "text_remove_newlines": (text.remove_newlines, "string", False, 1), "text_trim": (text.trim, "string", False, 2),
    "sliding_window": (text.ngrams, "array<string>", False, 2), "iscc_meta": (_meta_rows, META, True, 4), "iscc_text": (codes.text_codes, TEXT, True, 1), "iscc_image": (codes.image_code, ISCC, False, 2),
    "iscc_audio": (codes.audio_code, ISCC, False, 2), "iscc_video": (codes.video_code, ISCC, False, 2), "iscc_mixed": (codes.mixed_code, MIXED, False, 2), "iscc_data": (codes.data_code, ISCC, False, 2),
    "iscc_instance": (codes.instance_code, INSTANCE, False, 2), "iscc_sum": (codes.sum_code, SUM, False, 4), "iscc_compose": (codec.composed, "string", False, 2), "iscc_decode": (_decoded, DECODED, False, 1),
    "iscc_decompose": (codec.decomposed, "array<string>", False, 1), "iscc_component": (codec.component, "string", False, 5), "base32": (codec.base32, "string", False, 1), "base64_url": (codec.base64_url, "string", False, 1),
    "json_data_url": (jcs.json_url, "string", False, 1), "multihash": (codes.multihash, "string", False, 1),
}


@udtf(returnType="pos int, gram string")
class Ngrams:
    """``SELECT * FROM ngrams(text, width)``"""

    def eval(self, s: str, width: int) -> Iterator[tuple[int, str]]:
        if s is not None:
            yield from enumerate(text.ngrams(s, width))


@udtf(returnType="seq int, chunk binary")
class CdcChunks:
    """``SELECT * FROM cdc_chunks(data, average)``"""

    def eval(self, data: bytes, average: int) -> Iterator[tuple[int, bytes]]:
        if data is not None:
            yield from enumerate(cdc.split(bytes(data), average=average))


@udtf(returnType="pos int, unit string")
class Decompose:
    """``SELECT * FROM decompose(code)``"""

    def eval(self, code: str) -> Iterator[tuple[int, str]]:
        if code is not None:
            yield from enumerate(codec.decomposed(code))


def register(spark: SparkSession) -> list[str]:
    """Registers everything, the ``chunked_files`` source included, and returns the functions' names.

    Arguments are those of the kernels, all of them given.
    """
    from pyspark.sql.functions import arrow_udf

    for name, (kernel, ddl, batch, n) in FUNCTIONS.items():
        by_count, kind = _made(kernel, ddl, False, batch, ())
        spark.udf.register(name, arrow_udf(by_count[n], kind))
    for name, table in (("ngrams", Ngrams), ("cdc_chunks", CdcChunks), ("decompose", Decompose)):
        spark.udtf.register(name, table)
    spark.dataSource.register(ChunkedFiles)
    return [*FUNCTIONS, "ngrams", "cdc_chunks", "decompose"]
