"""Headers, base32, units and composites."""

from __future__ import annotations

import base64
from collections.abc import Iterator

from prismark.tables import PREFIX, MainType, SubType, Version

# A header number's classes as (prefix bits, prefix, value bits, least value).
CLASSES = ((1, 0b0, 3, 0), (2, 0b10, 6, 8), (3, 0b110, 9, 72), (4, 0b1110, 12, 584))
# The bits by which a composite's header tells its optional units.
UNIT_BITS = {MainType.CONTENT: 1, MainType.SEMANTIC: 2, MainType.META: 4}


def varnibble(n: int) -> str:
    """A header number as bits, in whole nibbles."""
    for size, prefix, width, least in CLASSES:
        if least <= n < least + (1 << width):
            return f"{prefix:0{size}b}{n - least:0{width}b}"
    raise ValueError(f"varnibble value out of range (0-4679): {n}")


def read_varnibble(bits: str, at: int) -> tuple[int, int]:
    """A number and where the next begins."""
    for size, prefix, width, least in CLASSES:
        if bits[at : at + size] == f"{prefix:0{size}b}":
            end = at + size + width
            if end > len(bits):
                break
            return int(bits[at + size : end], 2) + least, end
    raise ValueError("invalid or truncated varnibble")


def header(mtype: int, stype: int, version: int, length: int) -> bytes:
    bits = "".join(map(varnibble, (mtype, stype, version, length)))
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def read_header(data: bytes) -> tuple[MainType, SubType, Version, int, bytes]:
    """Types, version, length field and the rest after the header."""
    bits, at, found = "".join(f"{b:08b}" for b in data[:8]), 0, []
    for _ in range(4):
        n, at = read_varnibble(bits, at)
        found.append(n)
    try:
        return MainType(found[0]), SubType(found[1]), Version(found[2]), found[3], data[-(-at // 8) :]
    except ValueError as e:
        raise ValueError(f"invalid header: {e}") from None


def length_field(mtype: MainType, bits: int) -> int:
    if mtype == MainType.ISCC:
        if 0 <= bits <= 7:
            return bits
    elif mtype == MainType.ID:
        if 64 <= bits <= 96 and bits % 8 == 0:
            return (bits - 64) // 8
    elif bits >= 32 and bits % 32 == 0:
        return bits // 32 - 1
    raise ValueError(f"invalid length {bits} for {mtype.name}")


def bits_of(mtype: MainType, field: int, stype: SubType) -> int:
    if mtype == MainType.ISCC:
        return 256 if stype == SubType.WIDE else field.bit_count() * 64 + 128
    return field * 8 + 64 if mtype == MainType.ID else (field + 1) * 32


def units_field(types: list[MainType]) -> int:
    out = 0
    for t in types:
        if t not in UNIT_BITS:
            raise ValueError(f"{t.name} is not valid as optional unit")
        out |= UNIT_BITS[t]
    return out


def field_units(field: int) -> list[MainType]:
    """The optional units of a composite, in the order of their bodies."""
    if not 0 <= field <= 7:
        raise ValueError(f"invalid unit field {field}")
    return [t for t in (MainType.META, MainType.SEMANTIC, MainType.CONTENT) if field & UNIT_BITS[t]]


def base32(data: bytes) -> str:
    return base64.b32encode(data).decode().rstrip("=")


def read_base32(text: str) -> bytes:
    """Strict but for case: the text is what its bytes encode to."""
    upper = text.upper()
    try:
        out = base64.b32decode(upper + "=" * (-len(upper) % 8))
    except ValueError as e:
        raise ValueError(f"base32 decode error: {e}") from None
    if base32(out) != upper:
        raise ValueError("base32 decode error: trailing bits")
    return out


def base64_url(data: bytes) -> str:
    return base64.urlsafe_b64encode(data).decode().rstrip("=")


def without_prefix(code: str) -> str:
    return code.removeprefix(PREFIX)


def unit(mtype: MainType, stype: int, version: int, bits: int, digest: bytes) -> str:
    """A unit's text, without prefix; a short digest makes a short body."""
    if mtype == MainType.ISCC:
        raise ValueError("ISCC MainType is not a unit")
    return base32(header(mtype, stype, version, length_field(mtype, bits)) + digest[: bits // 8])


def component(mtype: int, stype: int, version: int, bits: int, digest: bytes) -> str:
    """``unit`` with its arguments checked."""
    try:
        mtype, stype, version = MainType(mtype), SubType(stype), Version(version)
    except ValueError as e:
        raise ValueError(str(e)) from None
    if len(digest) < bits // 8:
        raise ValueError(f"digest length {len(digest)} < bit_length/8 ({bits // 8})")
    return unit(mtype, stype, version, bits, digest)


def decoded(code: str) -> tuple[int, int, int, int, bytes]:
    """Types, version, length field and digest of one unit or composite; dashes don't matter."""
    mtype, stype, version, field, rest = read_header(read_base32(without_prefix(code).replace("-", "")))
    size = bits_of(mtype, field, stype) // 8
    if len(rest) < size:
        raise ValueError(f"decoded body too short: expected {size} bytes, got {len(rest)}")
    return int(mtype), int(stype), int(version), field, rest[:size]


def decomposed(code: str) -> list[str]:
    """The units of a composite, or of units one after another, without prefix."""
    return list(_units(read_base32(without_prefix(code))))


def _units(data: bytes) -> Iterator[str]:
    def taken(rest: bytes, size: int) -> bytes:
        if len(rest) < size:
            raise ValueError(f"truncated ISCC body: expected {size} bytes, got {len(rest)}")
        return rest

    while data:
        mtype, stype, version, field, rest = read_header(data)
        if mtype != MainType.ISCC:
            bits = bits_of(mtype, field, stype)
            yield unit(mtype, stype, version, bits, taken(rest, bits // 8))
            data = rest[bits // 8 :]
            continue
        types = field_units(field)
        size = 16 if stype == SubType.WIDE else 8
        if stype == SubType.WIDE:
            rest, types = taken(rest, 32)[:32], []
        taken(rest, 8 * len(types) + 2 * size)
        for k, t in enumerate(types):
            yield unit(t, SubType.NONE if t == MainType.META else stype, version, 64, rest[8 * k :])
        yield unit(MainType.DATA, SubType.NONE, version, 8 * size, rest[len(rest) - 2 * size : len(rest) - size])
        yield unit(MainType.INSTANCE, SubType.NONE, version, 8 * size, rest[len(rest) - size :])
        return


def composed(codes: list[str], wide: bool = False) -> str:
    """The composite of units, with prefix; Data and Instance are needed."""
    plain = [without_prefix(c) for c in codes]
    if len(plain) < 2:
        raise ValueError("at least 2 ISCC unit codes required")
    for c in plain:
        if len(c.encode()) < 16:
            raise ValueError(f"ISCC unit code too short (min 16 chars): {c}")
    units = sorted((read_header(read_base32(c)) for c in plain), key=lambda u: u[0])
    types = [u[0] for u in units]
    if types[-2:] != [MainType.DATA, MainType.INSTANCE]:
        raise ValueError("Data-Code and Instance-Code are mandatory")
    long = all(bits_of(t, field, s) >= 128 for t, s, _, field, _ in units)
    size, named = 8, {u[1] for u in units if u[0] in (MainType.SEMANTIC, MainType.CONTENT)}
    if wide and len(units) == 2 and long:
        size, stype = 16, SubType.WIDE
    elif len(named) > 1:
        raise ValueError("mixed SubTypes among Content/Semantic units")
    elif named:
        stype = named.pop()
    else:
        stype = SubType.SUM if len(units) == 2 else SubType.ISCC_NONE
    body = b"".join(u[4][:size] for u in units)
    return PREFIX + base32(header(MainType.ISCC, stype, Version.V0, units_field(types[:-2])) + body)
