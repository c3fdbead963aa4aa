"""Canonical JSON (RFC 8785) and data URLs."""

from __future__ import annotations

import base64
import json
import math
import re


def number(x: int | float) -> str:
    """As ECMAScript prints a double."""
    if isinstance(x, int) and abs(x) <= 1 << 53:
        return str(x)
    x = float(x)
    if not math.isfinite(x):
        raise ValueError("invalid JSON: a number is out of range")
    if x == 0:
        return "0"
    digits, _, power = repr(abs(x)).partition("e") if "e" in repr(abs(x)) else (repr(abs(x)), "", "0")
    whole, _, fraction = digits.partition(".")
    raw = (whole + fraction).lstrip("0")
    point = len(whole) + int(power) - (len(whole + fraction) - len(raw))
    raw = raw.rstrip("0")
    n = len(raw)
    if n <= point <= 21:
        text = raw + "0" * (point - n)
    elif 0 < point <= 21:
        text = f"{raw[:point]}.{raw[point:]}"
    elif -6 < point <= 0:
        text = "0." + "0" * -point + raw
    else:
        text = f"{raw[0]}{'.' + raw[1:] if n > 1 else ''}e{point - 1:+d}"
    return "-" * (x < 0) + text


def text(x: object) -> str:
    if isinstance(x, dict):
        return "{" + ",".join(f"{string(k)}:{text(v)}" for k, v in sorted(x.items(), key=lambda kv: kv[0].encode("utf-16-be", "surrogatepass"))) + "}"
    if isinstance(x, list):
        return "[" + ",".join(map(text, x)) + "]"
    if isinstance(x, str):
        return string(x)
    return {None: "null", True: "true", False: "false"}[x] if x is None or isinstance(x, bool) else number(x)


def string(x: str) -> str:
    return json.dumps(x, ensure_ascii=False)


def _refuse(name: str) -> None:
    raise ValueError(f"invalid JSON: {name}")


def parsed(source: str) -> object:
    try:
        return json.loads(source, parse_constant=_refuse)
    except (json.JSONDecodeError, RecursionError) as e:
        raise ValueError(f"invalid JSON: {e}") from None


def canonical(source: str) -> bytes:
    """The canonical form of JSON text."""
    return text(parsed(source)).encode("utf-8", "surrogatepass")


def url_of(payload: bytes, value: object) -> str:
    """A data URL of canonical JSON; linked data has its own type."""
    kind = "application/ld+json" if isinstance(value, dict) and "@context" in value else "application/json"
    return f"data:{kind};base64,{base64.b64encode(payload).decode()}"


def json_url(source: str) -> str:
    value = parsed(source)
    return url_of(text(value).encode("utf-8", "surrogatepass"), value)


BASE64 = re.compile(r"(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?")


def payload(url: str) -> bytes:
    """The bytes of a data URL: strict padded base64 after its first comma."""
    _, comma, rest = url.partition(",")
    if not comma:
        raise ValueError("invalid Data-URL: missing comma separator")
    if not BASE64.fullmatch(rest):
        raise ValueError("invalid base64 in Data-URL")
    out = base64.b64decode(rest)
    if base64.b64encode(out).decode() != rest:
        raise ValueError("invalid base64 in Data-URL")
    return out
