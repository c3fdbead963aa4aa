"""File scans."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from prismark.kernels.codec import composed
from prismark.kernels.codes import DataHasher, InstanceHasher, sum_codes
from prismark.tables import READ_SIZE

CODES = ("iscc", "datahash", "filesize", "units")
SUMS = "path string, iscc string, datahash string, filesize bigint, units array<string>"


def files(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, content`` of the files under a path or glob; a row holds a whole file of less than 2 GiB.

    Spark's scan leaves empty files out, and longer files don't fit a row; ``ChunkedFiles`` reads both.
    """
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


#: Bytes of short files that are hashed together, beyond which a file is read and hashed in pieces of so many bytes.
PIECE = 4 << 20


def reached(spark: SparkSession, path: str) -> tuple[str, str] | None:
    """The folder above a path's wildcards, as Spark names it and as a URI that Arrow's file systems reach, or None.

    Names that only Hadoop knows, as those of ``viewfs``, are resolved.
    """
    from pyarrow import fs

    plain = re.split(r"[*?\[{]", path, maxsplit=1)[0]
    place = spark._jvm.org.apache.hadoop.fs.Path(plain if plain == path else plain.rpartition("/")[0] or "/")
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    uri = system.resolvePath(place).toUri().toString()
    try:
        fs.FileSystem.from_uri(uri)
    except (OSError, ValueError):
        return None
    return system.makeQualified(place).toString(), uri


def file_codes(spark: SparkSession, path: str, bits: int = 64, wide: bool = False, units: bool = False) -> DataFrame:
    """``path`` and the sum code's fields for each file.

    Spark reads files of at most ``PIECE`` bytes, and so many bytes of them are hashed together. A longer file is read by
    Arrow's file systems and hashed piece by piece, so a task holds a piece and a hash state, however long a file is. Where
    they don't reach the path, Spark reads it as one row, of less than 2 GiB.
    """
    found, there, most = files(spark, path), reached(spark, path), PIECE

    def told(paths: list[str], rows: list[dict]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.string())]
        return pa.record_batch([pa.array(paths, pa.string()), *[pa.array([r[n] for r in rows], k) for n, k in zip(CODES, kinds, strict=True)]], ["path", *CODES])

    def by_piece(pieces: Iterable[bytes]) -> dict:
        data, instance = DataHasher(), InstanceHasher()
        for x in pieces:
            data.update(x)
            instance.update(x)
        d, i = data.finalize(bits), instance.finalize(bits)
        parts = [d["iscc"], i["iscc"]]
        return {"iscc": composed(parts, wide), "datahash": i["datahash"], "filesize": i["filesize"], "units": parts if units else None}

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, some, size = [], [], 0
        for b in batches:
            for name, raw in zip(b.column(0), b.column(1), strict=True):
                raw = raw.as_buffer()
                if raw.size > most:
                    yield told([name.as_py()], [by_piece(raw[k : k + most].to_pybytes() for k in range(0, raw.size, most))])
                    continue
                if some and size + raw.size > most:
                    yield told(paths, sum_codes(some, bits, wide, units))
                    paths, some, size = [], [], 0
                paths.append(name.as_py())
                some.append(raw.to_pybytes())
                size += raw.size
        if some:
            yield told(paths, sum_codes(some, bits, wide, units))

    def of_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        named, uri = there
        system, place = fs.FileSystem.from_uri(uri)
        for b in batches:
            for name in b.column(0).to_pylist():
                with system.open_input_stream(place + name.removeprefix(named), compression=None, buffer_size=0) as f:
                    yield told([name], [by_piece(iter(lambda: f.read(most), b""))])  # noqa: B023

    if there is None:
        return found.select("path", "content").mapInArrow(of_rows, SUMS)
    short = found.where(F.col("length") <= most).select("path", "content").mapInArrow(of_rows, SUMS)
    return short.unionByName(found.where(F.col("length") > most).select("path").mapInArrow(of_paths, SUMS))


#: The usual size of a Parquet row group, which no split divides.
ROW_GROUP = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if its input is so small that row groups may be fewer than cores.

    For work that costs far more than a shuffle of its input; a scan of a row group or more for each core stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * ROW_GROUP else df


class ChunkedFiles(DataSource):
    """``spark.read.format("chunked_files").option("size", n).load(uri)``: files of any length as rows of chunks.

    A file is one task and one chunk at a time is in memory. The path is a URI of a file or folder that Arrow's file
    systems reach (file, hdfs, s3, gs). Rows: path, seq, last, data.
    """

    @classmethod
    def name(cls) -> str:
        return "chunked_files"

    def schema(self) -> str:
        return "path string, seq bigint, last boolean, data binary"

    def reader(self, schema) -> DataSourceReader:
        return ChunkReader(self.options["path"], int(self.options.get("size", READ_SIZE)))


class ChunkReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, place = fs.FileSystem.from_uri(self.path)
        info = system.get_file_info(place)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(f"Cannot open file {self.path}")
        if info.type == fs.FileType.Directory:
            return [InputPartition(f.path) for f in system.get_file_info(fs.FileSelector(place, recursive=True)) if f.type == fs.FileType.File]
        return [InputPartition(place)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.path)
        with system.open_input_stream(partition.value, compression=None) as f:
            seq, data = 0, f.read(self.size)
            while True:
                ahead = f.read(self.size)
                yield pa.record_batch([pa.array([partition.value]), pa.array([seq], pa.int64()), pa.array([not ahead]), pa.array([data], pa.binary())], ["path", "seq", "last", "data"])
                if not ahead:
                    return
                seq, data = seq + 1, ahead

