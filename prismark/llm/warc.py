"""WARC archives: written as whole-file gzip streams, normalised to a member per record with an offset index, read back.

An archive that is one gzip stream can only be read from its start. The normaliser inflates such a file once, in chunks,
writes each record as a gzip member of its own and a sidecar index (offset, length, record id, type, payload digest: a
line per record), so that any record can be read by itself. Files that already have several members are taken alike.

Files lie in the shared folder and are reached through its file system's URI from every executor. A task's files bear its
attempt's number and count only through the table of what the finished attempts wrote, so a lost executor or a task that
ran twice leaves files that nothing reads.

Of records with equal payloads of at least ``least`` bytes the one with the largest id is the response; the others
revisit it: they keep the HTTP head and the digest, not the payload.

Defined results: a null payload is an empty one; rows that share id and payload are responses alike if theirs is the
largest id; a null id refers to the largest id of its payload, if there is one, and is a response otherwise; a null URL
has no header; an empty table writes no archive and gives no rows. A stream that ends early or isn't a WARC file raises
``ValueError``.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismark.llm.common import shared_dir, slices, written

CHUNK = 1 << 20
#: Raw bytes after which a task begins its next archive.
ARCHIVE_BYTES = 64 << 20
#: Tasks that files are dealt over at most.
MOST_TASKS = 1 << 15
DATE = "1970-01-01T00:00:00Z"
PREFIX = "urn:x-page:"
MANIFEST = "archive string, records long, raw_bytes long"
INDEX = "archive string, sidecar string, records long, bytes long"
REPORT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, url string"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """A response, or a revisit if it refers to another record."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{PREFIX}{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe='!#$%&()*+,/:;=?@[]~-._' + chr(39))}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{PREFIX}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """A record's header fields, by lower-case name, and its block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields["content-length"])
    if len(rest) < size:
        raise ValueError("a record ends early")
    return fields, rest[:size]


def inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The content of a gzip file, whatever members it has, in bounded pieces."""
    z, any_member = zlib.decompressobj(31), False
    for data in chunks:
        while data:
            if z.eof:
                z = zlib.decompressobj(31)
            any_member = True
            yield z.decompress(data, 4 * CHUNK)
            while z.unconsumed_tail:
                yield z.decompress(z.unconsumed_tail, 4 * CHUNK)
            data = z.unused_data
    if any_member and not z.eof:
        raise ValueError("the gzip stream ends early")


def records(content: Iterator[bytes]) -> Iterator[bytes]:
    """The raw records of a WARC stream, each with the two line ends after it."""
    held, ended = bytearray(), False

    def more() -> bool:
        nonlocal ended
        for piece in content:
            if piece:
                held.extend(piece)
                return True
        ended = True
        return False

    while True:
        while (at := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("the archive ends inside a header")
                return
        size = next((int(x.partition(b":")[2]) for x in bytes(held[:at]).split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
        if size is None or not held.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        end = at + 4 + size + 4
        while len(held) < end:
            if not more():
                raise ValueError("the archive ends inside a record")
        yield bytes(held[:end])
        del held[:end]


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def members(path: fs.FileSystem, name: str) -> Iterator[bytes]:
    with path.open_input_stream(name, compression=None) as f:
        while data := f.read(CHUNK):
            yield data


def packed_member(raw: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def arrays(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64()}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    cols = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.record_batch([pa.array(c, kinds[t]) for c, t in zip(cols, types, strict=True)], list(names))


def with_roles(df: DataFrame, key: str, url: str, payload: str, least: int) -> DataFrame:
    """``page_id, url, data, refers_to``. Only payloads that occur more than once take part in the join.

    They are written first: joined with the sums as they come, the copies of one payload would stay together in one task.
    """
    pages = df.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("string").cast("binary"), F.lit(b"")).alias("data"))
    pages = pages.withColumn("digest", F.when(F.octet_length("data") >= least, F.sha1("data")))
    again = pages.where("digest is not null").groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = written(again, f"{shared_dir(df.sparkSession)}/repeated")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("first")), F.lit(None)).otherwise(F.col("first"))
    return pages.join(again, "digest", "left").select("page_id", "url", "data", refers.alias("refers_to"))


def archived(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes archives of one gzip stream each; a row for each archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, (files, place), n, out = TaskContext.get(), opened(folder), 0, []
        f = z = None

        def close() -> None:
            nonlocal f
            f.write(z.flush())
            f.close()
            f = None

        for b in slices(batches):
            for page_id, url, data, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if f is None:
                    files.create_dir(place, recursive=True)
                    name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{n:04d}.warc.gz"
                    f, z, n = files.open_output_stream(f"{place}/{name}", compression=None), zlib.compressobj(6, zlib.DEFLATED, 31), n + 1
                    out.append([f"{folder}/{name}", 0, 0])
                raw = record(page_id, url, data, digest_of(data), refers_to)
                f.write(z.compress(raw))
                out[-1][1] += 1
                out[-1][2] += len(raw)
                if out[-1][2] >= archive_bytes:
                    close()
        if f is not None:
            close()
        yield arrays([tuple(x) for x in out], MANIFEST)

    return rows.select("page_id", "url", "data", "refers_to").mapInArrow(run, MANIFEST)


def normalised(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrites each archive with a member per record, and its sidecar; a row for each archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, (files, place) = TaskContext.get().taskAttemptId(), opened(folder)
        for b in batches:
            for uri in b.column(0).to_pylist():
                files.create_dir(place, recursive=True)
                source, name = opened(uri)
                new = f"{place}/{name.rpartition('/')[2].removesuffix('.warc.gz')}-{attempt}"
                offset, n = 0, 0
                with files.open_output_stream(f"{new}.warc.gz", compression=None) as f, files.open_output_stream(f"{new}.idx", compression=None) as index:
                    for raw in records(inflated(members(source, name))):
                        fields, _ = parsed(raw)
                        data = packed_member(raw)
                        f.write(data)
                        index.write(f"{offset} {len(data)} {fields.get('warc-record-id', '-')} {fields.get('warc-type', '-')} {fields.get('warc-payload-digest', '-')}\n".encode())
                        offset, n = offset + len(data), n + 1
                uri_of = f"{folder}/{new.rpartition('/')[2]}"
                yield arrays([(f"{uri_of}.warc.gz", f"{uri_of}.idx", n, offset)], INDEX)

    return archives.select("archive").mapInArrow(run, INDEX)


def read_back(index: DataFrame) -> DataFrame:
    """Every record of normalised archives, each read by its place in the sidecar; payloads are digested anew."""

    def number(value: str | None) -> int | None:
        text = (value or "").strip("<>").removeprefix(PREFIX)
        return int(text) if text else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive, sidecar in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                (files, place), (other, side) = opened(archive), opened(sidecar)
                lines = b"".join(members(other, side)).decode().splitlines()
                out = []
                with files.open_input_file(place) as f:
                    for line in lines:
                        offset, length, _, kind, told = line.split(" ")
                        fields, block = parsed(zlib.decompress(f.read_at(int(length), int(offset)), 31))
                        head, _, payload = block.partition(b"\r\n\r\n")
                        size = next(int(x.partition(b":")[2]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        digest = told.removeprefix("sha1:")
                        if kind == "response" and (digest_of(payload) != digest or len(payload) != size):
                            raise ValueError(f"a payload differs from its digest: {line}")
                        out.append((number(fields["warc-record-id"]), size, digest, kind, number(fields.get("warc-refers-to")), archive.rpartition("/")[2], int(offset), fields.get("warc-target-uri")))
                        if len(out) >= 4096:
                            yield arrays(out, REPORT)
                            out = []
                yield arrays(out, REPORT)

    return index.select("archive", "sidecar").mapInArrow(run, REPORT)


def one_each(rows: DataFrame) -> DataFrame:
    """The rows of a table of files over as many partitions, or ``MOST_TASKS``: then a task has several files, one by one."""
    n = min(rows.count(), MOST_TASKS)
    return rows.repartition(n) if n > 1 else rows


def archive_report(df: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """Writes, normalises and reads back the archives of a table of pages."""
    path = shared_dir(df.sparkSession)
    archives = written(archived(with_roles(df, key, url, payload, least), f"{path}/streams"), f"{path}/archives")
    index = written(normalised(one_each(archives), f"{path}/records"), f"{path}/index")
    return read_back(one_each(index))
