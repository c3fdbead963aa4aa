"""Assets that lie as ordered pieces, one row each."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismark.kernels.codec import composed
from prismark.kernels.codes import DataHasher, InstanceHasher, data_codes, instance_codes

#: Bytes of whole assets that are hashed together, and beyond which one asset is hashed as its pieces come.
TOGETHER = 4 << 20


def piece_codes(df: DataFrame, key: str, seq: str, data: str, bits: int = 64) -> DataFrame:
    """``key, data_code, instance_code, sum_code, datahash, filesize`` of each asset's pieces in the order of ``seq``.

    Pieces are sorted by asset. Short assets are gathered and hashed together; one of more than ``TOGETHER`` bytes is
    hashed as its pieces come, so a task holds that many bytes and a hash state, however long an asset is. A null piece is empty; pieces with equal seq are in the order of their bytes; without null keys.
    """
    kind = df.schema[key].dataType
    names = [key, "data_code", "instance_code", "sum_code", "datahash", "filesize"]
    schema = T.StructType([T.StructField(key, kind), *[T.StructField(n, T.StringType()) for n in names[1:5]], T.StructField("filesize", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: list[tuple] = []  # key and bytes of finished short assets
        size, now, pieces, hashers, key_type = 0, None, None, None, None

        def told(keys: list, d: list[dict], i: list[dict]) -> pa.RecordBatch:
            columns = [[x["iscc"] for x in d], [x["iscc"] for x in i], [composed([x["iscc"], y["iscc"]]) for x, y in zip(d, i, strict=True)], [y["datahash"] for y in i]]
            return pa.record_batch([pa.array(keys, key_type), *[pa.array(c, pa.string()) for c in columns], pa.array([y["filesize"] for y in i], pa.int64())], names)

        def flushed() -> pa.RecordBatch:
            nonlocal size
            data = [x for _, x in whole]
            out = told([k for k, _ in whole], data_codes(data, bits), instance_codes(data, bits))
            whole.clear()
            size = 0
            return out

        def ended() -> Iterator[pa.RecordBatch]:
            nonlocal size
            if hashers is not None:
                size -= own
                for h in hashers:
                    h.update(b"".join(pieces))
                yield told([now], [hashers[0].finalize(bits)], [hashers[1].finalize(bits)])
            elif pieces is not None:
                whole.append((now, b"".join(pieces)))

        for b in batches:
            key_type = b.column(0).type
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if pieces is None or k != now:
                    yield from ended()
                    if size >= TOGETHER:
                        yield flushed()
                    now, pieces, hashers, own = k, [], None, 0
                raw = raw or b""
                size, own = size + len(raw), own + len(raw)
                pieces.append(raw)
                if own > TOGETHER:  # many pieces at once: the hashers' arrays are slow if they are short
                    hashers, size, own = hashers or (DataHasher(), InstanceHasher()), size - own, 0
                    for h in hashers:
                        h.update(b"".join(pieces))
                    pieces = []
        yield from ended()
        if whole:
            yield flushed()

    rows = df.where(F.col(key).isNotNull()).select(F.col(key), F.col(seq).alias("__seq"), F.col(data).cast("binary").alias("__data"))
    return rows.repartition(key).sortWithinPartitions(key, "__seq", "__data").select(key, "__data").mapInArrow(run, schema)
