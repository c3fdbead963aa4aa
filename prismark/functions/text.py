"""Text functions. Spark's ``trim`` and ``\\s`` know fewer blanks than Unicode, so white space is spelled out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prismark.functions.arrow import column
from prismark.kernels import text as kernel

_SPACE = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in kernel.SPACE) + "]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, f"^{_SPACE}+|{_SPACE}+$", "")


def text_clean(c: Column | str) -> Column:
    return column(kernel.clean, "string", c)


def text_collapse(c: Column | str) -> Column:
    return column(kernel.collapse, "string", c)


def text_remove_newlines(c: Column | str) -> Column:
    """Native: runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(_col(c), f"{_SPACE}+", " "))


def text_trim(c: Column | str, most: int) -> Column:
    """Native: the longest start of at most ``most`` bytes that is whole characters, without white space at its ends."""
    raw = _col(c).cast("binary")
    whole = [F.try_validate_utf8(F.substring(raw, 1, k).cast("string")) for k in range(most, max(most - 4, -1), -1)]
    return _stripped(F.when(F.octet_length(raw) <= most, _col(c)).otherwise(F.coalesce(*whole)))


def sliding_window(c: Column | str, width: int) -> Column:
    """Native: all runs of so many characters; a shorter text is one, the empty one included."""
    if width < 2:
        raise ValueError("Sliding window width must be 2 or bigger.")
    # Characters first: finding the i-th character of a string takes time in proportion to i. The array of one binds
    # them to a name; written out they would be made anew for each run.
    bound = F.array(F.regexp_extract_all(_col(c), F.lit("(?s)."), F.lit(0)))
    starts = lambda x: F.sequence(F.lit(1), F.greatest(F.size(x) - (width - 1), F.lit(1)))
    runs = F.transform(bound, lambda x: F.transform(starts(x), lambda i: F.array_join(F.slice(x, i, F.lit(width)), "")))
    return F.when(_col(c).isNotNull(), F.element_at(runs, 1))


def sliding_window_bytes(c: Column | str, width: int) -> Column:
    """Native: the same over bytes."""
    if width < 2:
        raise ValueError("Sliding window width must be 2 or bigger.")
    s = _col(c).cast("binary")
    return F.when(s.isNotNull(), F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(s) - (width - 1), F.lit(1))), lambda i: F.substring(s, i, F.lit(width))))
