"""Known answers of every generator, through Spark: ``answers`` as rows, ``selftest`` as one word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismark import functions as P


def _stream(digits: str) -> Column:
    """A vector's bytes, spelled as vectors spell them."""
    return P.stream_bytes(F.lit(f"stream:{digits}"))


def _meta(name: str, description: str | None = None, meta: str | None = None) -> Column:
    return P.meta_code(*[F.lit(x).cast("string") for x in (name, description, meta)])


UNITS = ("AAAYPXW445FTYNJ3", "EAARMJLTQCUWAND2", "GABVVC5DMJJGYKZ4ZBYVNYABFFYXG", "IADWIK7A7JTUAQ2D6QARX7OBEIK3OOUAM42LOBLCZ4ZOGDLRHMDL6TQ")

# Published inputs and outputs.
KNOWN = {
    "meta of a name": (lambda: _meta("Die Unendliche Geschichte").iscc, "ISCC:AAAZXZ6OU74YAZIM"),
    "meta of a name and a description": (lambda: _meta("Die Unendliche Geschichte", "Von Michael Ende").iscc, "ISCC:AAAZXZ6OU4E45RB5"),
    "meta of a name and an object": (lambda: _meta("Hello", None, '{"some":"object"}').iscc, "ISCC:AAAWKLHFXN63LHL2"),
    "meta of a name and a data URL": (lambda: _meta("Hello", None, "data:application/json;charset=utf-8;base64,eyJzb21lIjogIm9iamVjdCJ9").iscc, "ISCC:AAAWKLHFXN43ICP2"),
    "meta, canonical number": (lambda: _meta("Test", None, '{"value":1.0}').meta, "data:application/json;base64,eyJ2YWx1ZSI6MX0="),
    "meta, its hash": (lambda: _meta("Test", None, '{"value":1.0}').metahash, "1e2010b291d392b6999ffe4aa4661fb343fc371fca3bfb5bb4e8d8226fdf85743232"),
    "meta, the hash of a large number": (lambda: _meta("Test", None, '{"value":1e20}').metahash, "1e201ff83c1822c348717658a0b4713739646da7c59832691b337a457416ddd1c73d"),
    "text": (lambda: P.text_code(F.lit("Hello World")).iscc, "ISCC:EAASKDNZNYGUUF5A"),
    "text, empty": (lambda: P.text_code(F.lit("")).iscc, "ISCC:EAASL4F2WZY7KBXB"),
    "text, characters": (lambda: P.text_code(F.lit("Hello World")).characters.cast("string"), "10"),
    "image, black": (lambda: P.image_code(F.unhex(F.lit("00" * 1024))).iscc, "ISCC:EEAQAAAAAAAAAAAA"),
    "image, white": (lambda: P.image_code(F.unhex(F.lit("ff" * 1024)), 128).iscc, "ISCC:EEBYAAAAAAAAAAAAAAAAAAAAAAAAA"),
    "audio, empty": (lambda: P.audio_code(F.array().cast("array<int>")).iscc, "ISCC:EIAQAAAAAAAAAAAA"),
    "audio, one feature": (lambda: P.audio_code(F.array(F.lit(1)), 128).iscc, "ISCC:EIBQAAAAAEAAAAABAAAAAAAAAAAAA"),
    "audio, signed features": (lambda: P.audio_code(F.array(F.lit(-1), F.lit(0), F.lit(1)), 256).iscc, "ISCC:EIDQAAAAAH777777AAAAAAAAAAAACAAAAAAP777774AAAAAAAAAAAAI"),
    "video": (lambda: P.video_code(F.array(F.array_repeat(F.lit(0), 380))).iscc, "ISCC:EMAQAAAAAAAAAAAA"),
    "mixed, parts": (lambda: F.array_join(P.mixed_code(F.array(F.lit("EUA6GIKXN42IQV3S"), F.lit("EIAUKMOUIOYZCKA5"))).parts, " "), "EUA6GIKXN42IQV3S EIAUKMOUIOYZCKA5"),
    "data": (lambda: P.data_code(_stream("ff00")).iscc, "ISCC:GAAXL2XYM5BQIAZ3"),
    "instance": (lambda: P.instance_code(_stream("")).iscc, "ISCC:IAA26E2JXH27TING"),
    "instance, its hash": (lambda: P.instance_code(_stream("")).datahash, "1e20af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"),
    "multihash": (lambda: P.multihash(F.lit("hello world").cast("binary")), "1e20d74981efa70a0c880b8d8c1985d075dbcbf679b99a5f9914e5aaf96b831a9e24"),
    "composite": (lambda: P.compose(F.array(*map(F.lit, UNITS))), "ISCC:KACYPXW445FTYNJ3CYSXHAFJMA2HUWULUNRFE3BLHRSCXYH2M5AEGQY"),
    "decoded digest": (lambda: F.lower(F.hex(P.decode(F.lit("GAA2XTPPAERUKZ4J")).digest)), "abcdef0123456789"),
    "decomposed": (lambda: F.array_join(P.decompose(F.lit("ISCC:AAAYPXW445FTYNJ3")), " "), "AAAYPXW445FTYNJ3"),
}


def answers(spark: SparkSession) -> DataFrame:
    """``name, code``: what comes out for each published input."""
    # Columns over a row, not constants: constant folding would leave Python out.
    made = F.array(*[F.struct(F.lit(name).alias("name"), make().alias("code")) for name, (make, _) in KNOWN.items()])
    return spark.range(1).select(F.inline(made))


def selftest(spark: SparkSession) -> bool:
    """Whether all known answers come out; what differs is printed; never raises."""
    try:
        wrong = {r.name: r.code for r in answers(spark).collect() if r.code != KNOWN[r.name][1]}
    except Exception as e:  # noqa: BLE001
        print(f"selftest: {e}")
        return False
    if wrong:
        print(f"selftest: {wrong}")
    return not wrong
