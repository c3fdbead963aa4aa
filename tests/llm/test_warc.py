import base64
import gzip
import hashlib

import pytest

from prismark.llm import warc
from prismark.llm.common import shared_dir

PAGES = [(1, "http://a/é b?x=1", "<p>one</p>"), (2, None, None), (3, "u", ""), (4, "u\r\nX: y", "<p>one</p>"), (5, "v", "x\r\n\r\nWARC/1.1\r\n" * 50), (6, "w", "é" * 300_000), (7, "w", "<p>one</p>"), (None, "n", "<p>one</p>"), (None, "n", "alone"), (8, "same", "twice"), (8, "same", "twice")]


def want(pages, least=0):
    out = []
    for i, _, html in pages:
        raw = (html or "").encode()
        same = [j for j, _, h in pages if (h or "").encode() == raw and j is not None]
        first = max(same, default=None) if len([1 for _, _, h in pages if (h or "").encode() == raw]) > 1 and len(raw) >= least else i
        revisit = first is not None and first != i
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 11, 10**9])
def test_round_trip(spark, least):
    df = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, digest string").repartition(2)
    got = warc.archive_report(df, least=least).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == want(PAGES, least)
    assert {r.url for r in got if r.page_id == 4} == {"u%0D%0AX:%20y"}
    assert warc.archive_report(df.limit(0)).count() == 0


def test_files(spark):
    """The first files are one member each; the rewritten ones a member per record, as the sidecar says."""
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    path = shared_dir(spark)
    archives = warc.archived(warc.with_roles(df, "page_id", "url", "html", 0), f"{path}/streams", archive_bytes=2000).collect()
    assert sum(a.records for a in archives) == len(PAGES) and len(archives) > 1
    streams = [open(a.archive.removeprefix("file://"), "rb").read() for a in archives]
    assert all(s.count(b"\x1f\x8b\x08\x00") == 1 for s in streams)
    index = warc.normalised(spark.createDataFrame([(a.archive,) for a in archives], "archive string"), f"{path}/records").collect()
    for a, i, s in zip(archives, index, streams, strict=True):
        data = open(i.archive.removeprefix("file://"), "rb").read()
        lines = open(i.sidecar.removeprefix("file://")).read().splitlines()
        assert len(lines) == i.records == a.records and len(data) == i.bytes
        assert gzip.decompress(data) == gzip.decompress(s)
        at = 0
        for line in lines:
            offset, length, name, kind, _ = line.split(" ")
            assert int(offset) == at
            fields, _ = warc.parsed(gzip.decompress(data[at : at + int(length)]))
            assert fields["warc-record-id"] == name and fields["warc-type"] == kind
            at += int(length)
        assert at == len(data)
    # Files that have a member per record already are taken alike.
    again = warc.normalised(spark.createDataFrame([(index[0].archive,)], "archive string"), f"{path}/again").first()
    assert open(again.archive.removeprefix("file://"), "rb").read() == open(index[0].archive.removeprefix("file://"), "rb").read()


def test_streams_in_any_pieces():
    raws = [warc.record(i, "u", b"x" * n, "D", None) for i, n in enumerate((0, 1, 5000))]
    whole = b"".join(raws)
    for data in (gzip.compress(whole), b"".join(map(gzip.compress, raws))):
        for step in (1, 7, 1000, 10**6):
            assert list(warc.records(warc.inflated(data[k : k + step] for k in range(0, len(data), step)))) == raws
        with pytest.raises(ValueError):
            list(warc.records(warc.inflated(iter([data[:-20]]))))
    for bad in (b"no warc at all\r\n\r\n", whole[:-3], b"WARC/1.1\r\nContent-Length: 5"):
        with pytest.raises(ValueError):
            list(warc.records(iter([bad])))
    assert list(warc.records(iter([]))) == []
