"""Codec functions. Headers, lengths and unit bits are native expressions; base32 is an Arrow call."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prismark.functions.arrow import column
from prismark.kernels import codec
from prismark.tables import MainType, SubType, Version

DECODED = "struct<mtype:int,stype:int,version:int,length:int,digest:binary>"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _decoded(code: str) -> dict:
    return dict(zip(("mtype", "stype", "version", "length", "digest"), codec.decoded(code), strict=True))


def decode(code) -> Column:
    return column(_decoded, DECODED, code)


def try_decode(code) -> Column:
    return column(_decoded, DECODED, code, lenient=True)


def decompose(code) -> Column:
    return column(codec.decomposed, "array<string>", code)


def try_decompose(code) -> Column:
    return column(codec.decomposed, "array<string>", code, lenient=True)


def compose(units, wide: bool = False) -> Column:
    return column(codec.composed, "string", units, wide=wide)


def try_compose(units, wide: bool = False) -> Column:
    return column(codec.composed, "string", units, wide=wide, lenient=True)


def encode_component(mtype, stype, version, bits, digest) -> Column:
    return column(codec.component, "string", mtype, stype, version, bits, digest)


def to_base32(data) -> Column:
    return column(codec.base32, "string", data)


def read_base32(text) -> Column:
    return column(codec.read_base32, "binary", text)


def base64_url(data) -> Column:
    """Native: URL-safe base64 without padding."""
    return F.translate(F.base64(_col(data).cast("binary")), "+/=\r\n", "-_")


def varnibble(n) -> Column:
    """Native: a header number as bits, in whole nibbles; null beyond 4,679."""
    n, out = _col(n), None
    for size, prefix, width, least in codec.CLASSES:
        bits = F.concat(F.lit(f"{prefix:0{size}b}"), F.lpad(F.bin(n - least), width, "0"))
        out = (F if out is None else out).when(n.between(least, least + (1 << width) - 1), bits)
    return out


def read_varnibble(bits) -> Column:
    """Native: ``value`` of the number that a string of bits begins with, and the ``rest``; null if there is none."""
    bits, out = _col(bits), None
    for size, prefix, width, least in codec.CLASSES:
        value = (F.conv(F.substring(bits, size + 1, width), 2, 10).cast("int") + least).alias("value")
        found = F.struct(value, bits.substr(size + width + 1, 64).alias("rest"))
        out = (F if out is None else out).when(bits.startswith(f"{prefix:0{size}b}") & (F.length(bits) >= size + width), found)
    return out


def encode_header(mtype, stype, version, length) -> Column:
    """Native: a header's bytes, with zeros up to a whole byte; null if a number is beyond 4,679."""
    bits = F.concat(*map(varnibble, (mtype, stype, version, length)))
    digits = (F.floor((F.length(bits) + 7) / 8) * 2).cast("int")
    return F.unhex(F.lpad(F.conv(F.rpad(bits, digits * 4, F.lit("0")), 2, 16), digits, F.lit("0")))


def decode_header(data) -> Column:
    """Native: ``mtype, stype, version, length`` of a header and the ``tail`` after it; null if it is invalid or cut off."""
    data = _col(data).cast("binary")
    front = F.substring(data, 1, 8)
    bits = F.lpad(F.conv(F.hex(front), 16, 2), F.octet_length(front) * 8, F.lit("0"))
    start = F.struct(bits.alias("rest"), F.array().cast("array<int>").alias("found"))

    def step(state: Column, _: Column) -> Column:
        got = read_varnibble(state["rest"])
        return F.when(got.isNotNull(), F.struct(got["rest"].alias("rest"), F.array_append(state["found"], got["value"]).alias("found")))

    def told(state: Column) -> Column:
        found = state["found"]
        at = F.ceil((F.length(bits) - F.length(state["rest"])) / 8)
        fields = [found[k].alias(n) for k, n in enumerate(("mtype", "stype", "version", "length"))]
        tail = F.unhex(F.substr(F.hex(data), (at * 2 + 1).cast("int"))).alias("tail")
        return F.when((found[0] <= max(MainType)) & (found[1] <= max(SubType)) & (found[2] <= max(Version)), F.struct(*fields, tail))

    return F.when(F.octet_length(data) > 0, F.aggregate(F.sequence(F.lit(1), F.lit(4)), start, step, told))


def length_field(mtype, bits) -> Column:
    """Native: a header's length field; null where the number of bits is invalid."""
    m, b = _col(mtype), _col(bits)
    return (
        F.when(m == int(MainType.ISCC), F.when(b.between(0, 7), b))
        .when(m == int(MainType.ID), F.when(b.between(64, 96) & (b % 8 == 0), (b - 64).cast("bigint") / 8))
        .otherwise(F.when((b >= 32) & (b % 32 == 0), b / 32 - 1))
        .cast("int")
    )


def length_bits(mtype, field, stype) -> Column:
    """Native: the number of bits that a header's length field stands for."""
    m, n = _col(mtype), _col(field)
    composite = F.when(_col(stype) == int(SubType.WIDE), 256).otherwise(F.bit_count(n) * 64 + 128)
    return F.when(m == int(MainType.ISCC), composite).when(m == int(MainType.ID), n * 8 + 64).otherwise((n + 1) * 32).cast("int")


def units_field(types) -> Column:
    """Native: a composite's unit bits from an array of main types; null if one can't be optional."""
    bit = lambda t: F.when(t == int(MainType.CONTENT), 1).when(t == int(MainType.SEMANTIC), 2).when(t == int(MainType.META), 4)
    return F.aggregate(_col(types), F.lit(0), lambda a, t: a.bitwiseOR(bit(t)))


def read_units_field(field) -> Column:
    """Native: the main types of a composite's optional units, in the order of their bodies; null beyond 7."""
    n = _col(field)
    listed = [F.when(n.bitwiseAND(bit) > 0, int(t)) for t, bit in sorted(codec.UNIT_BITS.items())]
    return F.when(n.between(0, 7), F.array_compact(F.array(*listed)))
