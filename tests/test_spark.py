import importlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismark import functions as P
from prismark import operators as O
from prismark import sql
from prismark.kernels import codec, codes, minhash, sequences, simhash, text
from prismark.selftest import selftest
from prismark.sources import ChunkedFiles, file_codes, piece_codes
from prismark.streaming import stream_codes

TEXTS = ["", "a", "Hello World", " x\r\n\n\n y\t", "é" * 30, "日本語テキスト" * 20, "The quick brown fox, jumps! " * 40, None, "a b　c\x1cd\x85e"]


def values(df, expr):
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, t, t.encode() if t is not None else None) for i, t in enumerate(TEXTS)], "i int, t string, b binary").repartition(3).cache()


def each(f):
    return [None if t is None else f(t) for t in TEXTS]


def test_text_functions(rows):
    assert values(rows, P.text_clean("t")) == each(text.clean)
    assert values(rows, P.text_collapse("t")) == each(text.collapse)
    assert values(rows, P.text_remove_newlines("t")) == each(text.remove_newlines)
    for n in (0, 1, 2, 3, 4, 5, 31, 128):
        assert values(rows, P.text_trim("t", n)) == each(lambda t, n=n: text.trim(t, n)), n
    for w in (2, 3, 13):
        assert values(rows, P.sliding_window("t", w)) == each(lambda t, w=w: text.ngrams(t, w))
    four = values(rows, P.sliding_window_bytes("b", 4))
    assert four[2][:2] == [b"Hell", b"ello"] and four[0] == [b""] and four[1] == [b"a"]
    with pytest.raises(ValueError):
        P.sliding_window("t", 1)


def test_codes(rows):
    got = values(rows, P.text_code("t"))
    assert [None if r is None else r.asDict() for r in got] == each(lambda t: codes.text_codes([t])[0])
    assert [r and r.asDict() for r in values(rows, P.instance_code("b"))] == each(lambda t: codes.instance_code(t.encode()))
    assert [r and r.asDict() for r in values(rows, P.data_code("b"))] == each(lambda t: codes.data_code(t.encode()))
    assert [r and r.asDict() for r in values(rows, P.sum_code("b", units=True))] == each(lambda t: codes.sum_code(t.encode(), units=True))

    def meta(t):
        try:
            return codes.meta_code(t)
        except ValueError:
            return None

    assert [r and r.asDict() for r in values(rows, P.try_meta_code("t"))] == each(meta)
    with pytest.raises(Exception, match="empty after normalization"):
        values(rows, P.meta_code("t"))
    assert values(rows, P.multihash("b"))[2] == codes.multihash(b"Hello World")


def test_relational_forms_agree_with_kernels(spark, rows):
    grams = O.ngram_rows(rows.select("i", P.text_collapse("t").alias("c")).where("c is not null"), "c", 13, "i")
    features = grams.select("i", P.xxh32(F.col("gram").cast("binary")).alias("f"))
    by_agg = {r.i: bytes(r.digest) for r in O.minhash_digests(features, "f", "i").collect()}
    assert by_agg == {i: codes.text_digests([text.collapse(t)])[0] for i, t in enumerate(TEXTS) if t is not None}
    rng = random.Random(1)
    for ansi in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        big = [0, 1, 2**32 - 1, 2**31, *[rng.randrange(2**32) for _ in range(50)]]
        d = O.minhash_digests(spark.createDataFrame([(1, f) for f in big], "k int, f bigint"), "f", "k").first().digest
        assert bytes(d) == minhash.digest(np.array(big, dtype=np.uint64))
    spark.conf.unset("spark.sql.ansi.enabled")
    tracks = {k: [rng.randrange(-(2**31), 2**31) for _ in range(k)] for k in range(1, 14)}
    flat = spark.createDataFrame([(k, p, v) for k, vs in tracks.items() for p, v in enumerate(vs)], "k int, p int, v int")
    assert {r.k: bytes(r.digest) for r in O.audio_digests(flat, "v", "p", "k").collect()} == {k: sequences.audio_digest(np.array(v)) for k, v in tracks.items()}
    want = {k: simhash.simhash([int(x % 2**32).to_bytes(4, "big") for x in v]) for k, v in tracks.items()}
    assert {r.k: bytes(r.digest) for r in O.simhash_digests(flat, "v", "k").collect()} == want
    video = [[rng.randrange(-50, 50) for _ in range(380)] for _ in range(4)]
    df = spark.createDataFrame([(1, video + video[:2])], "k int, frames array<array<int>>")
    for bits in (32, 64, 256):
        assert bytes(O.video_digest_native(df, "frames", "k", bits=bits).first().digest) == sequences.video_digest(video, bits)
    assert df.select(P.video_code("frames")).first()[0].iscc == codes.video_code(video)["iscc"]
    parts = O.split_parts(spark.createDataFrame([(1, i) for i in range(5)], "k int, p int"), 3, ["p"], "k").orderBy("p").collect()
    assert [r.part for r in parts] == [1, 1, 2, 2, 3]


def test_codec_columns(spark):
    units = ["AAAYPXW445FTYNJ3", "EAARMJLTQCUWAND2", "GABVVC5DMJJGYKZ4ZBYVNYABFFYXG", "IADWIK7A7JTUAQ2D6QARX7OBEIK3OOUAM42LOBLCZ4ZOGDLRHMDL6TQ"]
    df = spark.createDataFrame([(0, units), (1, units[:1]), (2, None)], "i int, u array<string>")
    whole = codec.composed(units)
    assert values(df, P.try_compose("u")) == [whole, None, None]
    one = spark.createDataFrame([(whole, 2, 0, 0, 64, bytes(range(8)))], "c string, m int, s int, v int, b int, d binary")
    r = one.select(P.decompose("c").alias("parts"), P.decode("c").alias("x"), P.encode_component("m", "s", "v", "b", "d").alias("u"), P.to_base32("d").alias("t"), P.base64_url("d").alias("w")).first()
    assert r.parts == codec.decomposed(whole) and r.x.mtype == 5 and r.u == codec.unit(2, 0, 0, 64, bytes(range(8))) and r.t == codec.base32(bytes(range(8))) and r.w == codec.base64_url(bytes(range(8)))
    assert one.select(P.encode_component("m", "s", "v", "b", F.lit(None).cast("binary"))).first()[0] is None
    assert [x.unit for x in O.decompose_rows(one, "c").orderBy("pos").collect()] == codec.decomposed(whole)
    grid = spark.createDataFrame([(m, n) for m in range(8) for n in range(300)], "m int, n int")

    def field(m, n):
        try:
            return codec.length_field(codec.MainType(m), n)
        except ValueError:
            return None

    for r in grid.select("m", "n", P.length_field("m", "n").alias("f"), P.length_bits("m", F.col("n") % 8, F.lit(0)).alias("b")).collect():
        assert r.f == field(r.m, r.n) and r.b == codec.bits_of(codec.MainType(r.m), r.n % 8, 0)
    assert bytes(grid.where("m = 3 and n = 1").select(P.encode_header("m", F.lit(0), F.lit(0), "n")).first()[0]) == codec.header(3, 0, 0, 1)
    assert spark.createDataFrame([([0, 1, 2],)], "t array<int>").select(P.units_field("t")).first()[0] == 7


def test_files_and_pieces(spark, tmp_path):
    spark.dataSource.register(ChunkedFiles)
    rng = random.Random(3)
    data = {f"f{n}": rng.randbytes(n) for n in (0, 1, 1000, 5000, 70_000)}
    for name, raw in data.items():
        (tmp_path / name).write_bytes(raw)
    want = {n: codes.sum_code(raw) for n, raw in data.items()}
    by_file = {r.path.rpartition("/")[2]: r for r in file_codes(spark, f"file://{tmp_path}").collect()}
    assert {n: r.iscc for n, r in by_file.items()} == {n: w["iscc"] for n, w in want.items() if n != "f0"}
    pieces = spark.read.format("chunked_files").option("size", 999).load(f"file://{tmp_path}")
    by_piece = {r.path.rpartition("/")[2]: r for r in piece_codes(pieces, "path", "seq", "data").collect()}
    assert {n: (r.sum_code, r.datahash, r.filesize) for n, r in by_piece.items()} == {n: (w["iscc"], w["datahash"], w["filesize"]) for n, w in want.items()}


def test_long_assets_go_piece_by_piece(spark, monkeypatch):
    from prismark.sources import pieces as module

    monkeypatch.setattr(module, "TOGETHER", 2000)
    rng = random.Random(5)
    assets = {k: [rng.randbytes(rng.randrange(900)) for _ in range(k % 7)] + [None] for k in range(40)}
    rows = [(k, n, None if p is None else bytearray(p)) for k, ps in assets.items() for n, p in enumerate(ps)]
    got = {r.k: r for r in piece_codes(spark.createDataFrame(rows, "k int, n int, d binary").repartition(3), "k", "n", "d").collect()}
    for k, ps in assets.items():
        raw = b"".join(p or b"" for p in ps)
        assert (got[k].data_code, got[k].instance_code, got[k].filesize) == (codes.data_code(raw)["iscc"], codes.instance_code(raw)["iscc"], len(raw))
    assert len(got) == 40


def test_long_files_are_hashed_in_pieces(spark, tmp_path, monkeypatch):
    """None of the files comes whole to the kernel whose memory is a multiple of its input; all codes stay."""
    module = importlib.import_module("prismark.sources.files")
    rng = random.Random(6)
    data = {f"f{n}": rng.randbytes(n) for n in (1, 4000, 4999, 5000, 5001, 70_000)}
    for name, raw in data.items():
        (tmp_path / name).write_bytes(raw)
    want = {n: codes.sum_code(raw, 128, True, True) for n, raw in data.items()}

    def few(rows, *args):
        assert sum(map(len, rows)) <= 5000
        return codes.sum_codes(rows, *args)

    monkeypatch.setattr(module, "PIECE", 5000)
    monkeypatch.setattr(module, "sum_codes", few)
    for reach in (module.reached, lambda *_: None):  # as Arrow reads them, and as Spark's rows
        monkeypatch.setattr(module, "reached", reach)
        got = file_codes(spark, f"file://{tmp_path}/f*", 128, True, True).collect()
        assert {r.path.rpartition("/")[2]: {k: r[k] for k in ("iscc", "datahash", "filesize", "units")} for r in got} == want


def test_chunked_files_over_folders(spark, tmp_path):
    """A table may be a folder; files of two tables may have one name."""
    from prismark.plans import queries

    rng = random.Random(8)
    for name in ("region.parquet", "documents.parquet/part-0", "documents.parquet/part-1", "pages.parquet/part-0", "other.parquet"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(rng.randbytes(rng.randrange(200_000)))
    (tmp_path / "pages.parquet/_SUCCESS").touch()
    rows = queries()["chunked_files"](spark, str(tmp_path)).collect()
    assert sorted((r.name, r.same) for r in rows) == [("documents.parquet", True), ("pages.parquet", True), ("region.parquet", True)]


def test_stream(spark, tmp_path):
    rng = random.Random(9)
    assets = {f"a{k}": [rng.randbytes(rng.randrange(3000)) for _ in range(4)] for k in range(5)}
    schema = "asset_id string, seq long, data binary, last boolean"
    for turn in range(4):
        rows = [(a, turn, bytearray(p[turn]), turn == 3) for a, p in assets.items() if not (a == "a4" and turn == 3)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    q = stream_codes(stream).writeStream.format("memory").queryName("codes").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.asset_id: r for r in spark.table("codes").collect()}
    assert set(got) == {"a0", "a1", "a2", "a3"}
    for a, r in got.items():
        whole = b"".join(assets[a])
        assert (r.data_code, r.instance_code, r.filesize) == (codes.data_code(whole)["iscc"], codes.instance_code(whole)["iscc"], len(whole))


def test_stream_tells_what_comes_out_of_order_or_after_the_end(spark, tmp_path):
    """Batches in this order: a gap, a repeat, a late piece, pieces after the end in their own and in later batches."""
    batches = [
        [("whole", 0, b"ab", False), ("gap", 0, b"a", False), ("gap", 2, b"c", True), ("twice", 0, b"a", False), ("long", 0, b"x", True), ("long", 1, b"y", False), ("open", 0, b"abc", False)],
        [("whole", 1, b"c", True), ("gap", 1, b"b", False), ("twice", 0, b"a", True), ("late", 1, b"b", False)],
        [("late", 0, b"a", False), ("whole", 2, b"d", False), ("whole", 3, b"d", True)],
    ]
    schema = "asset_id string, seq long, data binary, last boolean"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_codes(stream).writeStream.format("memory").queryName("told").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
    q.stop()
    got = sorted((r.asset_id, r.status, r.filesize) for r in spark.table("told").collect())
    after = "pieces after the end"
    assert got == sorted([
        ("whole", "complete", 3), ("whole", after, None), ("gap", "expected piece 1, got 2", 1), ("gap", after, None), ("twice", "expected piece 1, got 0", 1),
        ("long", "complete", 1), ("long", after, None), ("late", "expected piece 2, got 0", 1),
    ])
    r = spark.table("told").where("asset_id = 'whole' and status = 'complete'").first()
    assert (r.data_code, r.datahash) == (codes.data_code(b"abc")["iscc"], codes.multihash(b"abc"))
    assert spark.table("told").where("status <> 'complete' and data_code is not null").count() == 0


def test_headers(spark):
    """Native headers and numbers against the kernel's, at the bounds of their classes, and what is no header."""
    numbers = [0, 1, 7, 8, 71, 72, 583, 584, 4679]
    df = spark.createDataFrame([(k % 8, n % 8, n) for k, n in enumerate(numbers)], "m int, s int, n int")
    got = df.select("m", "s", "n", P.varnibble("n").alias("v"), P.read_varnibble(F.concat(P.varnibble("n"), F.lit("0101"))).alias("r"), P.encode_header("m", "s", F.lit(0), "n").alias("h")).collect()
    for r in got:
        assert r.v == codec.varnibble(r.n) and (r.r.value, r.r.rest) == (r.n, "0101") and bytes(r.h) == codec.header(r.m, r.s, 0, r.n)
    told = df.select("m", "s", "n", P.decode_header(F.concat(P.encode_header("m", "s", F.lit(0), "n"), F.unhex(F.lit("00ff")))).alias("x")).collect()
    assert all((r.x.mtype, r.x.stype, r.x.version, r.x.length, bytes(r.x.tail)) == (r.m, r.s, 0, r.n, b"\x00\xff") for r in told)
    odd = spark.createDataFrame([(None,), (b"",), (b"\x00",), (b"\xff\xff\xff",), (b"\x00\x10",), (b"\x80\x00\x00",), (b"\x00\x00",)], "b binary")
    assert [r.x is not None for r in odd.select(P.decode_header("b").alias("x")).collect()] == [False] * 6 + [True]
    beyond = spark.createDataFrame([(4680,), (-1,), (None,)], "n int").select(P.varnibble("n").alias("v"), P.encode_header(F.lit(0), F.lit(0), F.lit(0), "n").alias("h")).collect()
    assert all(r.v is None and r.h is None for r in beyond)
    fields = spark.createDataFrame([(k,) for k in (-1, 0, 1, 2, 5, 7, 8, None)], "n int").select(P.read_units_field("n").alias("u")).collect()
    assert [r.u for r in fields] == [None, [], [2], [1], [0, 2], [0, 1, 2], None, None]


def test_stream_bytes(spark):
    got = spark.createDataFrame([("stream:",), ("stream:ff00",), ("ff00",), (None,)], "t string").select(P.stream_bytes("t").alias("b")).collect()
    assert [None if r.b is None else bytes(r.b) for r in got] == [b"", b"\xff\x00", None, None]


def test_sql(spark, rows):
    names = sql.register(spark)
    rows.createOrReplaceTempView("rows_v")
    r = spark.sql("SELECT iscc_text(t).iscc AS c, iscc_instance(b, 64).datahash AS h, iscc_meta(t, cast(null as string), cast(null as string), 64).iscc AS m FROM rows_v WHERE i = 2").first()
    assert (r.c, r.h) == ("ISCC:EAASKDNZNYGUUF5A", codes.multihash(b"Hello World")) and r.m == codes.meta_code("Hello World")["iscc"]
    assert [x.gram for x in spark.sql("SELECT * FROM ngrams('hello', 3)").orderBy("pos").collect()] == ["hel", "ell", "llo"]
    assert spark.sql("SELECT count(*) FROM rows_v, LATERAL cdc_chunks(b, 64)").first()[0] > len(TEXTS)
    assert "decompose" in names


def test_selftest(spark):
    assert selftest(spark)
