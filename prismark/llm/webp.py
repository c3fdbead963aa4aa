"""Lossless WebP as a media column: encode, decode, pixel arrays and features.

The decoder reads the whole lossless format: simple and normal prefix codes, several groups of codes by an entropy image,
back-references with the two-dimensional distance codes, the colour cache, and the four transforms (predictor,
cross-colour, subtract-green, palette with bundled pixels). Work goes by arrays, not by symbols: the symbol that would
start at every bit of a block is looked up at once, for each group of codes, and only the chain from pixel to pixel is
followed one by one. Back-references and cached colours are then resolved together, as pointers to earlier pixels.

The encoder chooses by estimated bits, for each picture: a transform of the pixels (none, a palette, subtract-green, a
predictor, cross-colour multipliers), earlier pixels to refer back to, the size of the colour cache or none, and one or two
groups of codes; what estimates find likely is encoded, and the smallest file is kept. ``features`` tells what a file uses. On bytes of text the cache and
back-references pay; neighbouring bytes don't predict each other as those of photographs do, so transforms are hardly
ever the smallest there.

Payload layout: four bytes are a pixel (red, green, blue, alpha), 144 pixels are a row, so 576 bytes are a row. Beyond
16384 rows a picture is wider; its last row may then go beyond the payload, whose size follows from ``n_bytes``. Beyond
113 * 16384 units of 576 bytes (1.07 GB) a picture is several files of one width, one after another.

Defined results: a null text is an empty payload, which is one row of 255; equal texts give equal media and features;
a damaged stream raises ``ValueError``; an empty table gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismark.llm.common import shared_dir, slices, written

UNIT = 576
ROW = UNIT // 4
#: Sides of an image have 14 bits.
SIDE = 1 << 14
#: Bits looked up at once; bounds a task's arrays.
BLOCK_BITS = 1 << 17
#: Longest code the encoder makes; the format allows 15.
LONGEST = 12
#: Groups of codes up to which a picture is read at once; with more, symbol by symbol.
MOST_AT_ONCE = 4
#: Pixels of the shortest and longest back-reference that the encoder makes.
LEAST_MATCH, LONGEST_MATCH = 3, 4096
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)

# Fixed values of the format: the order of the code length code, and the neighbours that the first 120 distances name.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEIGHBOURS = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def prefix_of(value: int) -> tuple[int, int, int]:
    """A length or distance from 1 on as (prefix symbol, extra bits, their value)."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    high = v.bit_length() - 1
    extra = high - 1
    return 2 * high + (v >> extra & 1), extra, v & ((1 << extra) - 1)


# Writing


class BitWriter:
    """Least significant bit first; small pieces one by one, arrays at once."""

    def __init__(self) -> None:
        self.values: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.small: list[tuple[int, int]] = []

    def put(self, value: int, bits: int) -> None:
        self.small.append((value, bits))

    def put_long(self, value: int, bits: int) -> None:
        """A piece of any size."""
        self.put_all(*words_of(value, bits))

    def flush(self) -> None:
        if self.small:
            v, n = zip(*self.small, strict=True)
            self.values.append(np.array(v, dtype=np.uint64))
            self.sizes.append(np.array(n, dtype=np.int64))
            self.small = []

    def put_all(self, values: np.ndarray, bits: np.ndarray) -> None:
        """Values of at most 62 bits."""
        self.flush()
        self.values.append(values.astype(np.uint64))
        self.sizes.append(bits.astype(np.int64))

    def bytes(self) -> bytes:
        self.flush()
        v, n = np.concatenate(self.values), np.concatenate(self.sizes)
        ends = np.cumsum(n)
        return joined(v, ends - n, int(ends[-1])).tobytes()[: ceil_div(int(ends[-1]), 8)]


def words_of(value: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A long piece as pieces of 32 bits."""
    n = ceil_div(bits, 32)
    sizes = np.full(n, 32, dtype=np.int64)
    sizes[-1:] -= 32 * n - bits
    return np.frombuffer(value.to_bytes(4 * n, "little"), dtype="<u4").astype(np.uint64), sizes


def joined(v: np.ndarray, starts: np.ndarray, total: int) -> np.ndarray:
    """Words of 32 bits with pieces of at most 62 bits at their places."""
    word, shift = starts >> 5, (starts & 31).astype(np.uint64)
    out = np.zeros((total >> 5) + 4, dtype=np.float64)
    low = (v << shift) & np.uint64(0xFFFFFFFF)  # bits of different pieces never meet, so sums are unions
    rest = np.where(shift > 0, v >> (np.uint64(32) - shift), v >> np.uint64(32))
    for k, part in enumerate((low, rest & np.uint64(0xFFFFFFFF), rest >> np.uint64(32))):
        out += np.bincount(word + k, weights=part.astype(np.float64), minlength=len(out))
    return out.astype(np.uint32)


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Lengths of a prefix code for the counts, at most ``longest`` bits; small counts are raised until it fits."""
    out = np.zeros(len(counts), dtype=np.int64)
    used = np.flatnonzero(counts)
    n = len(used)
    if n < 2:
        out[used] = 1
        return out
    used = used[np.argsort(counts[used], kind="stable")]
    sorted_weights = counts[used]
    floor = 1
    while True:
        # Leaves in order, then the nodes made of them, which come in order as well: the next is at either one's front.
        weights = np.maximum(sorted_weights, floor).tolist()
        weights.append(1 << 62)
        made: list[int] = []
        parent = [0] * (2 * n - 1)
        leaf, node, key = 0, 0, n
        for _ in range(n - 1):
            total = 0
            for _ in (0, 1):
                if node < key - n and made[node] < weights[leaf]:
                    total += made[node]
                    parent[n + node] = key
                    node += 1
                else:
                    total += weights[leaf]
                    parent[leaf] = key
                    leaf += 1
            made.append(total)
            key += 1
        depth = [0] * (2 * n - 1)
        for i in range(2 * n - 3, n - 1, -1):
            depth[i] = depth[parent[i]] + 1
        found = np.array(depth, dtype=np.int64)[np.array(parent[:n])] + 1
        if found.max() <= longest:
            out[used] = found
            return out
        floor *= 2


@lru_cache(maxsize=16)
def turned(bits: int) -> np.ndarray:
    """Every number of so many bits, with its bits in reverse."""
    n, out = np.arange(1 << bits, dtype=np.int64), np.zeros(1 << bits, dtype=np.int64)
    for k in range(bits):
        out |= (n >> k & 1) << (bits - 1 - k)
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes for the lengths, as they stand in the stream (first bit lowest)."""
    out = np.zeros(len(lengths), dtype=np.int64)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    spans = 1 << (15 - lengths[order])
    out[order] = turned(15)[np.cumsum(spans) - spans]
    return out


@dataclass
class Code:
    """What the encoder needs of a prefix code; a code with one symbol takes no bits."""

    bits: np.ndarray
    sizes: np.ndarray


def put_code(w: BitWriter, counts: np.ndarray) -> Code:
    """Writes a prefix code and returns it."""
    value, bits, code = code_of(counts.astype(np.int64).tobytes())
    w.put_long(value, bits)
    return code


#: Sizes of the code that the encoder tells lengths by: one for all pictures, made for lengths of bytes of text.
OUTER = {0: 3, 6: 3, 7: 3, 8: 3, 5: 4, 9: 4, 17: 4, 18: 4, 4: 4, 10: 4, 3: 5, 16: 5, 2: 6, 11: 6, 12: 6, 1: 6}


@lru_cache(maxsize=1)
def outer_code() -> tuple[list[int], list[int], str]:
    """Sizes and bits of that code, and what comes before a code's lengths, as binary digits, the last bit first."""
    sizes = [OUTER.get(s, 0) for s in range(19)]
    order = [sizes[s] for s in LENGTH_ORDER]
    order = order[: max(k + 1 for k, x in enumerate(order) if x)]
    # No simple code; sizes in the order in which they are told; as many lengths as symbols.
    return sizes, canonical(np.array(sizes)).tolist(), "0" + "".join(format(x, "03b") for x in reversed(order)) + format(len(order) - 4, "04b") + "0"


@lru_cache(maxsize=4096)
def run_of(x: int, n: int, again: bool) -> str:
    """What tells ``n`` equal lengths, as binary digits, the last bit first; again: the last length but for zeros was the same."""
    runs: list[tuple[int, int, int]] = []  # symbol, extra value, extra bits
    if x == 0:
        while n >= 3:
            m = min(n, 138)
            runs.append((17, m - 3, 3) if m <= 10 else (18, m - 11, 7))
            n -= m
    else:
        if not again:
            runs.append((x, 0, 0))
            n -= 1
        while n >= 3:
            m = min(n, 6)
            runs.append((16, m - 3, 2))
            n -= m
    sizes, bits, _ = outer_code()
    runs += [(x, 0, 0)] * n
    return "".join(format(bits[s] | extra << sizes[s], f"0{sizes[s] + more}b") for s, extra, more in reversed(runs))


@lru_cache(maxsize=8)
def code_of(key: bytes) -> tuple[int, int, Code]:
    """A code for the counts, and what tells it as one number and its bits; channels with equal counts share one."""
    counts, value, at = np.frombuffer(key, dtype=np.int64), 0, 0

    def put(x: int, bits: int) -> None:
        nonlocal value, at
        value |= x << at
        at += bits

    used = np.flatnonzero(counts)
    if len(used) <= 2 and (not len(used) or used[-1] < 256):
        symbols = used.tolist() or [0]
        put(1, 1)
        put(len(symbols) - 1, 1)
        put(int(symbols[0] > 1), 1)
        put(symbols[0], 8 if symbols[0] > 1 else 1)
        if len(symbols) == 2:
            put(symbols[1], 8)
        sizes, bits = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
        if len(symbols) == 2:
            sizes[symbols], bits[symbols[1]] = 1, 1
        return value, at, Code(bits, sizes)
    lengths = code_lengths(counts)
    told, before = [outer_code()[2]], 8
    changes = [0, *(np.flatnonzero(lengths[1:] != lengths[:-1]) + 1).tolist(), len(lengths)]
    for x, start, end in zip(lengths[changes[:-1]].tolist(), changes, changes[1:], strict=False):
        told.append(run_of(x, end - start, x == before))
        before = x or before
    text = "".join(reversed(told))
    value, at = int(text, 2), len(text)
    if np.count_nonzero(lengths) == 1:
        return value, at, Code(np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64))
    return value, at, Code(canonical(lengths), lengths)


def prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``prefix_of`` for an array: prefix symbols, numbers of extra bits, their values."""
    v = values.astype(np.int64) - 1
    high = np.frexp(np.maximum(v, 1).astype(np.float64))[1].astype(np.int64) - 1
    extra = np.where(v < 4, 0, high - 1)
    return np.where(v < 4, v, 2 * high + (v >> extra & 1)), extra, np.where(v < 4, 0, v & ((1 << extra) - 1))


@lru_cache(maxsize=16)
def names_of(width: int) -> dict[int, int]:
    """Distance -> the first of the 120 codes that names it in a picture of this width."""
    out: dict[int, int] = {}
    for code in range(1, 121):
        out.setdefault(distance_of(code, width), code)
    return out


def earlier(keys: np.ndarray) -> np.ndarray:
    """For each place the last earlier one with an equal key, -1 where there is none."""
    order, out = np.argsort(keys, kind="stable"), np.full(len(keys), -1, dtype=np.int64)
    same = keys[order[1:]] == keys[order[:-1]]
    out[order[1:][same]] = order[:-1][same]
    return out


def matches(argb: np.ndarray, starts: np.ndarray | None = None, least: int = LEAST_MATCH) -> np.ndarray:
    """Back-references (place, length, distance) from left to right, each to the last place with the same ``least`` pixels.

    starts: where pictures begin, if there are several one after another; none refers to another picture.
    """
    n, starts = len(argb) - least + 1, np.zeros(1, np.int64) if starts is None else starts
    out: list[tuple[int, int, int]] = []
    if n >= 2:
        picture = np.searchsorted(starts, np.arange(len(argb)), side="right")
        ends = np.append(starts[1:], len(argb))
        key = picture[:n].astype(np.uint64)
        for k in range(least):
            key = (key ^ argb[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        before = earlier(key)
        some = np.flatnonzero(before >= 0)
        some = some[(picture[some] == picture[some + least - 1]) & (picture[before[some]] == picture[some])]
        for k in range(least):  # equal hashes are not enough
            some = some[argb[some + k] == argb[before[some] + k]]
        # Where the next place's reference goes on with this one's, a match is as long as that run of places.
        follows = np.append((some[1:] == some[:-1] + 1) & (before[some[1:]] == before[some[:-1]] + 1), False)
        last = np.flatnonzero(~follows)
        run = some[last[np.searchsorted(last, np.arange(len(some)))]] - some + least
        free = 0
        for i, j, m, end in zip(some.tolist(), before[some].tolist(), run.tolist(), ends[picture[some] - 1].tolist(), strict=True):
            if i >= free and end - i >= least:
                m = min(m, LONGEST_MATCH, end - i)
                out.append((i, m, i - j))
                free = i + m
    return np.array(out, dtype=np.int64).reshape(-1, 3)


def literals(n: int, copies: np.ndarray) -> np.ndarray:
    """The places of pixels that no back-reference covers."""
    change = np.zeros(n + 1, dtype=np.int8)
    change[copies[:, 0]] += 1
    np.subtract.at(change, copies[:, 0] + copies[:, 1], 1)
    return np.flatnonzero(np.cumsum(change[:-1], dtype=np.int8) == 0)


def slots_of(argb: np.ndarray, cache_bits: int) -> np.ndarray:
    return argb * np.uint32(CACHE_FACTOR) >> np.uint32(32 - cache_bits)


def cached(argb: np.ndarray, cache_bits: int) -> np.ndarray:
    """Which pixels are in the colour cache when their turn comes."""
    before = earlier(slots_of(argb, cache_bits))
    return (before >= 0) & (argb[before] == argb)


def put_image(w: BitWriter, argb: np.ndarray, main: bool, cache_bits: int = 0, width: int = 0, groups: np.ndarray | None = None, group_bits: int = 0, shared: bool = False, copies: np.ndarray | None = None) -> None:
    """Pixels in reading order: repeated ones as back-references, known ones by the cache, others as literals.

    groups: the group of codes for each block of 2^group_bits pixels square; width is that of the picture.
    """
    n, copies = len(argb), matches(argb) if copies is None else copies
    w.put(int(cache_bits > 0), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(int(groups is not None), 1)
        if groups is not None:
            w.put(group_bits - 2, 3)
            put_image(w, np.uint32(0xFF000000) | groups.ravel().astype(np.uint32) << np.uint32(8), False, width=groups.shape[1])
    places = literals(n, copies)
    pixels = argb[places].astype(np.int64)
    green, red, blue, alpha = ((pixels >> s) & 255 for s in (8, 16, 0, 24))
    plain = np.ones(len(places), dtype=bool)
    if cache_bits:
        plain = ~cached(argb, cache_bits)[places]
        green = np.where(plain, green, 280 + slots_of(argb, cache_bits)[places].astype(np.int64))
    at, length, back = copies.T
    name = names_of(width or n)
    p, p_extra, p_low = prefixes(length)
    q, q_extra, q_low = prefixes(np.array([name.get(x, x + 120) for x in back.tolist()], dtype=np.int64))
    whole = np.zeros(n, dtype=np.int64) if groups is None else spread(groups, group_bits, (ceil_div(n, width), width)).ravel()[:n].astype(np.int64)
    of_literal, of_copy = whole[places], whole[at]
    alphabet = 280 + (1 << cache_bits if cache_bits else 0)
    value, size = np.zeros(len(places), dtype=np.int64), np.zeros(len(places), dtype=np.int64)
    v, s = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
    for group in range(int(whole.max()) + 1 if groups is not None else 1):
        mine, ours = (slice(None), slice(None)) if groups is None else (of_literal == group, of_copy == group)
        known = plain[mine]
        counts = np.bincount(green[mine], minlength=alphabet) + np.bincount(256 + p[ours], minlength=alphabet)
        if shared:  # red, blue and alpha have one code
            every = np.bincount(np.concatenate([c[mine][known] for c in (red, blue, alpha)]), minlength=256)
            codes = [put_code(w, counts), *(put_code(w, every) for _ in range(3))]
        else:
            codes = [put_code(w, counts), *(put_code(w, np.bincount(c[mine][known], minlength=256)) for c in (red, blue, alpha))]
        d = put_code(w, np.bincount(q[ours], minlength=40))
        x, z = codes[0].bits[green[mine]], codes[0].sizes[green[mine]]
        for code, c in zip(codes[1:], (red, blue, alpha), strict=True):
            c = c[mine]
            x = x | np.where(known, code.bits[c], 0) << z
            z = z + np.where(known, code.sizes[c], 0)
        value[mine], size[mine] = x, z
        x, z = codes[0].bits[256 + p[ours]], codes[0].sizes[256 + p[ours]]
        for bits, more in ((p_low[ours], p_extra[ours]), (d.bits[q[ours]], d.sizes[q[ours]]), (q_low[ours], q_extra[ours])):
            x, z = x | bits << z, z + more
        v[ours], s[ours] = x, z
    if len(at):
        order = np.argsort(np.concatenate([places, at]), kind="stable")
        value, size = np.concatenate([value, v])[order], np.concatenate([size, s])[order]
    w.put_all(value, size)


#: Bits that a code takes, on average, to tell a symbol's length.
TOLD = 3.5
#: Bits of the colour cache that the encoder chooses by itself.
CACHE_BITS = 6
#: Blocks that an entropy image has its groups for, and what a second group has to save: it costs time as well.
GROUP_BITS, LEAST_SAVING = 4, 0.03


def bits_of(counts: np.ndarray) -> np.ndarray:
    """Estimated bits of codes and of the symbols in them, for counts in the last axis."""
    c = counts.astype(np.float64)
    total = c.sum(axis=-1)
    known = np.log2(c, out=np.zeros_like(c), where=c > 0)
    return total * np.log2(np.maximum(total, 1)) - (c * known).sum(axis=-1) + TOLD * np.count_nonzero(counts, axis=-1)


def mixed(images: list[np.ndarray]) -> list[bool]:
    """Whether blocks of a picture differ so much in the classes of their bytes (their upper four bits) that groups may pay."""
    width, rows = images[0].shape[1], np.array([len(x) for x in images])
    wide = ceil_div(width, 1 << GROUP_BITS)
    high = (rows + (1 << GROUP_BITS) - 1) >> GROUP_BITS
    of, first = np.repeat(np.arange(len(images)), rows), np.cumsum(rows) - rows
    start = np.cumsum(high * wide) - high * wide
    y = np.arange(int(rows.sum())) - first[of]
    block = (start[of] + (y >> GROUP_BITS) * wide)[:, None] + (np.arange(width) >> GROUP_BITS)
    c = np.concatenate(images).view(np.uint8).reshape(-1, width, 4)
    counts = np.bincount((block[:, :, None] * 16 + (c >> 4)).ravel(), minlength=int((high * wide).sum()) * 16).reshape(-1, 16).astype(np.float64)
    total = np.add.reduceat(counts, start, axis=0)
    size = total.sum(axis=1)
    plogp = lambda x: (x * np.log2(x, out=np.zeros_like(x), where=x > 0)).sum(axis=1)
    own = counts.sum(axis=1)
    inside = np.add.reduceat(own * np.log2(np.maximum(own, 1)) - plogp(counts), start)
    gain = size * np.log2(np.maximum(size, 1)) - plogp(total) - inside
    return (gain > np.maximum(LEAST_SAVING * 5 * size, 1000)).tolist()


def histograms(of: np.ndarray, symbols: np.ndarray, pictures: int, size: int) -> np.ndarray:
    """(pictures, size) counts of symbols."""
    return np.bincount(of * size + symbols, minlength=pictures * size).reshape(pictures, size)


def by_cache(argb: np.ndarray, of: np.ndarray, places: np.ndarray, pictures: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pictures are estimated to take fewer bits with a cache, and which literal places are then in it."""
    own, c = of[places], argb[places].view(np.uint8).reshape(-1, 4)
    slots = slots_of(argb, CACHE_BITS)
    key = of << CACHE_BITS | slots
    before = earlier(key.astype(np.uint16) if pictures <= 1 << 16 - CACHE_BITS else key)
    hit = ((before >= 0) & (argb[before] == argb))[places]

    def price(some: slice | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        o, d = own[some], c[some]
        return histograms(o, d[:, 1], pictures, 256), sum(histograms(o, d[:, k], pictures, 256) for k in (0, 2, 3))

    green, rest = price(slice(None))
    without = bits_of(green) + bits_of(rest)
    green, rest = price(~hit)
    known = histograms(own[hit], slots[places[hit]].astype(np.int64), pictures, 1 << CACHE_BITS)
    use = bits_of(np.concatenate([green, known], axis=1)) + bits_of(rest) < without
    return use, hit & use[own]


def groups_for(argb: np.ndarray, width: int, copies: np.ndarray) -> np.ndarray | None:
    """Two groups of codes by block, or None: blocks go to the nearer of two distributions of bytes, which are then theirs."""
    places = literals(len(argb), copies)
    wide = ceil_div(width, 1 << GROUP_BITS)
    block = (places // width >> GROUP_BITS) * wide + (places % width >> GROUP_BITS)
    n = ceil_div(ceil_div(len(argb), width), 1 << GROUP_BITS) * wide
    counts = histograms(np.repeat(block, 4), argb[places].view(np.uint8), n, 256)
    total, size = counts.sum(axis=0), counts.sum(axis=1)
    own = -(counts @ np.log2((total + 1) / (total.sum() + 256)))  # what each block costs with the code of all
    side = np.zeros(n, dtype=bool)
    side[np.argmax(np.where(size, own / np.maximum(size, 1), 0))] = True
    for _ in range(3):
        logs = np.stack([np.log2((counts[side == k].sum(axis=0) + 0.5) / (counts[side == k].sum() + 128)) for k in (False, True)], axis=1)
        price = -(counts @ logs)
        side = price[:, 1] < price[:, 0]
        if side.all() or not side.any():
            return None
    both = np.stack([counts[~side].sum(axis=0), counts[side].sum(axis=0)])
    best = float(bits_of(total))
    saved = best - float(bits_of(both).sum()) - TOLD * np.count_nonzero(both.min(axis=0)) - n - 100
    return side.astype(np.int64).reshape(-1, wide) if saved >= LEAST_SAVING * best else None


def transforms_for(images: list[np.ndarray]) -> list[tuple]:
    """The transforms that are estimated to save most for each picture of one width; mostly none, on text.

    The estimate looks at every fourth pixel of every row. One mode or multiplier serves a picture.
    """
    rows = np.array([len(x) for x in images])
    c = np.concatenate(images).view(np.uint8).reshape(int(rows.sum()), -1, 4)
    of = np.repeat(np.arange(len(images)), rows)
    first = np.cumsum(rows) - rows
    x, left = c[:, 3::4].astype(np.int16), c[:, 2:-1:4].astype(np.int16)
    top, corner = np.roll(x, 1, axis=0), np.roll(left, 1, axis=0)
    top[first], corner[first] = left[first], left[first]  # a first row is predicted from the left

    def price(v: np.ndarray) -> np.ndarray:
        at = (of * 256)[:, None, None] + (v & 255)
        counts = np.bincount(at.ravel(), minlength=256 * len(images)).reshape(-1, 256)
        return 4 * (bits_of(counts) - TOLD * np.count_nonzero(counts, axis=-1)) + TOLD * np.count_nonzero(counts, axis=-1)

    def shares() -> np.ndarray:
        """(pictures, 3) multipliers of green to red, green to blue, red to blue, by least squares."""
        s = x.astype(np.int8).astype(np.float64)
        sums = lambda v: np.add.reduceat(v.sum(axis=1), first)
        out = []
        for a, b in ((1, 2), (1, 0), (2, 0)):
            n = sums(np.ones_like(s[..., 0]))
            mean = sums(s[..., a]) / n, sums(s[..., b]) / n
            spread_of = sums(s[..., a] ** 2) / n - mean[0] ** 2
            out.append(np.where(spread_of > 0, (sums(s[..., a] * s[..., b]) / n - mean[0] * mean[1]) / np.maximum(spread_of, 1e-9), 0))
        out[2] = np.zeros_like(out[2])  # green's share of blue already has what red has in common with it
        return np.clip(np.round(32 * np.stack(out, axis=1)), -127, 127).astype(np.int64)

    by_green = x.copy()
    by_green[..., [0, 2]] -= x[..., 1:2]
    m = shares()
    crossed = x.copy()
    signed = x.astype(np.int8).astype(np.int64)
    crossed[..., 2] -= ((m[of, 0][:, None] * signed[..., 1]) >> 5).astype(np.int16)
    crossed[..., 0] -= ((m[of, 1][:, None] * signed[..., 1]) >> 5).astype(np.int16)
    told = 64  # bits of a block image of one colour
    candidates = [((), x, 0), ((("green",),), by_green, 3)]
    candidates += [((("predictor", 9, mode),), x - guess, told) for mode, guess in ((1, left), (2, top), (7, left + top >> 1), (12, np.clip(left + top - corner, 0, 255)))]
    candidates += [((("cross", 9, None),), crossed, told)]
    prices = np.stack([price(v) + extra for _, v, extra in candidates])
    out = []
    for k, best in enumerate(prices.argmin(axis=0).tolist()):
        shape = ceil_div(int(rows[k]), 512), ceil_div(images[k].shape[1], 512)
        chosen = []
        for name, *rest in candidates[best][0]:
            if name == "predictor":
                rest = [rest[0], np.full(shape, rest[1])]
            elif name == "cross":
                rest = [rest[0], np.tile(m[k], (*shape, 1))]
            chosen.append((name, *rest))
        out.append(tuple(chosen))
    return out


def encode(argb: np.ndarray, transforms: tuple = (), cache_bits: int | None = 0, groups: np.ndarray | None = None, group_bits: int = 0, shared: bool = False, by_cost: bool = False) -> bytes:
    """A lossless WebP file of a (height, width) array of 32-bit ARGB.

    transforms, in this order of application: ("predictor", block bits, modes), ("cross", block bits, multipliers),
    ("green",), ("palette",). modes and multipliers are block images, a mode or (green to red, green to blue, red to
    blue) as signed bytes for each block. groups: the group of codes for each block. shared: red, blue and alpha have one
    code, as suits bytes that are no colours. by_cost: the cache is chosen by estimated bits.
    """
    argb = np.ascontiguousarray(argb, dtype=np.uint32)
    height, width = argb.shape
    if not (0 < height <= SIDE and 0 < width <= SIDE):
        raise ValueError("a side must be from 1 to 16384 pixels")
    w = BitWriter()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(int(bool((argb >> 24 != 255).any())), 1)
    w.put(0, 3)
    for name, *rest in transforms:
        w.put(1, 1)
        if name == "palette":
            colours = np.unique(argb)
            if len(colours) > 256:
                raise ValueError("a palette has at most 256 colours")
            w.put(PALETTE, 2)
            w.put(len(colours) - 1, 8)
            parts = colours.view(np.uint8).reshape(-1, 4)
            put_image(w, np.concatenate([parts[:1], parts[1:] - parts[:-1]]).copy().view(np.uint32).ravel(), False)
            index = np.searchsorted(colours, argb).astype(np.uint32)
            bits = bundle_bits(len(colours))
            wide = ceil_div(argb.shape[1], 1 << bits)
            padded = np.zeros((height, wide << bits), dtype=np.uint32)
            padded[:, : argb.shape[1]] = index
            packed = np.zeros((height, wide), dtype=np.uint32)
            for k in range(1 << bits):
                packed |= padded[:, k :: 1 << bits] << np.uint32(k * (8 >> bits))
            argb = np.uint32(0xFF000000) | packed << np.uint32(8)
        elif name == "green":
            w.put(SUBTRACT_GREEN, 2)
            argb = add_green(argb, -1)
        else:
            bits, blocks = rest
            blocks = np.asarray(blocks)
            w.put(PREDICTOR if name == "predictor" else CROSS_COLOUR, 2)
            w.put(bits - 2, 3)
            if name == "predictor":
                image = np.uint32(0xFF000000) | blocks.astype(np.uint32) << np.uint32(8)
                argb = residuals(argb, blocks, bits)
            else:
                u = blocks.astype(np.int8).view(np.uint8).astype(np.uint32)
                image = np.uint32(0xFF000000) | u[..., 2] << np.uint32(16) | u[..., 1] << np.uint32(8) | u[..., 0]
                argb = cross_colour(argb, image, bits, -1)
            put_image(w, image.ravel(), False, width=image.shape[1])
    w.put(0, 1)
    flat = argb.ravel()
    copies = matches(flat)
    if by_cost:
        use, _ = by_cache(flat, np.zeros(len(flat), np.int64), literals(len(flat), copies), 1)
        cache_bits = CACHE_BITS if use[0] else 0
    put_image(w, flat, True, cache_bits, argb.shape[1], groups, group_bits, shared, copies)
    return in_file(w.bytes())


def in_file(data: bytes) -> bytes:
    """A lossless stream as a file."""
    data += b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(data) + 12) + b"WEBPVP8L" + struct.pack("<I", len(data)) + data


def encode_all(images: list[np.ndarray]) -> tuple[list[bytes], np.ndarray]:
    """``encode(image, shared=True, by_cost=True)`` of pictures of one width: the same files, made from arrays over all of them.

    Also tells which pictures have at most 256 colours that, on average, are told more than twice: a palette may pay there.
    """
    sizes, width, n = np.array([x.size for x in images]), images[0].shape[1], len(images)
    starts = np.cumsum(sizes) - sizes
    flat, of = np.concatenate([x.ravel() for x in images]), np.repeat(np.arange(n), sizes)
    copies = matches(flat, starts)
    places = literals(len(flat), copies)
    use, hit = by_cache(flat, of, places, n)
    own, plain, pixels = of[places], ~hit, flat[places].astype(np.int64)
    known = np.sort(own << 32 | pixels)
    colours = np.bincount(known[np.append(True, known[1:] != known[:-1])] >> 32, minlength=n)
    often = (colours <= 256) & (np.bincount(own, minlength=n) > 2 * colours)
    green, red, blue, alpha = ((pixels >> s) & 255 for s in (8, 16, 0, 24))
    green[hit] = 280 + slots_of(flat[places[hit]], CACHE_BITS)
    at, length, back = copies.T
    theirs, name = of[at], names_of(width)
    p, p_extra, p_low = prefixes(length)
    q, q_extra, q_low = prefixes(np.array([name.get(x, x + 120) for x in back.tolist()], dtype=np.int64))
    alphabet = 280 + (1 << CACHE_BITS)
    first = histograms(own, green, n, alphabet) + histograms(theirs, 256 + p, n, alphabet)
    rest = sum(histograms(own[plain], c[plain], n, 256) for c in (red, blue, alpha))
    distances = histograms(theirs, q, n, 40)
    codes = [tuple(np.zeros((n, m), dtype=np.int64) for _ in (0, 1)) for m in (alphabet, 256, 40)]
    heads, alpha_used = [], np.bitwise_and.reduceat(flat, starts) >> 24 != 255
    for k, image in enumerate(images):
        value = 0x2F | (width - 1) << 8 | (len(image) - 1) << 22 | int(alpha_used[k]) << 36
        bits = 41  # with three bits of version, and no transform
        value |= int(use[k]) << bits | (CACHE_BITS << bits + 1 if use[k] else 0)
        bits += 6 if use[k] else 2  # and one group of codes
        for counts, times, (all_bits, all_sizes) in zip((first[k, : alphabet if use[k] else 280], rest[k], distances[k]), (1, 3, 1), codes, strict=True):
            told, size, code = code_of(counts.tobytes())
            all_bits[k, : len(counts)], all_sizes[k, : len(counts)] = code.bits, code.sizes
            for _ in range(times):
                value, bits = value | told << bits, bits + size
        heads.append((value, bits))
    (gb, gs), (rb, rs), (db, ds) = codes
    value, size = gb[own, green], gs[own, green]
    for c in (red, blue, alpha):
        value = value | np.where(plain, rb[own, c], 0) << size
        size = size + np.where(plain, rs[own, c], 0)
    v, s = gb[theirs, 256 + p], gs[theirs, 256 + p]
    for x, more in ((p_low, p_extra), (db[theirs, q], ds[theirs, q]), (q_low, q_extra)):
        v, s = v | x << s, s + more
    order = np.argsort(np.concatenate([places, at]), kind="stable")
    value, size, owner = (np.concatenate(x)[order] for x in ((value, v), (size, s), (own, theirs)))
    # Each picture's stream begins at a word of its own.
    long = np.array([b for _, b in heads])
    total = long + np.bincount(owner, weights=size, minlength=n).astype(np.int64)
    begin = np.cumsum((total + 31) // 32) - (total + 31) // 32 << 5
    ends = np.cumsum(size)
    before = np.concatenate([[0], ends])[np.searchsorted(owner, np.arange(n))]
    pieces, lengths = zip(*(words_of(*x) for x in heads), strict=True)
    counts = np.array([len(x) for x in pieces])
    where = np.repeat(begin, counts) + 32 * (np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts))
    words = joined(np.concatenate([*pieces, value.astype(np.uint64)]), np.concatenate([where, ends - size + (begin + long - before)[owner]]), int(begin[-1] + total[-1]))
    return [in_file(words[b >> 5 : (b >> 5) + ceil_div(t, 32)].tobytes()[: ceil_div(t, 8)]) for b, t in zip(begin.tolist(), total.tolist(), strict=True)], often


# Transforms


def bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def add_green(argb: np.ndarray, sign: int) -> np.ndarray:
    """Green added to red and blue (or taken from them)."""
    out = argb.copy()
    c = out.view(np.uint8).reshape(*argb.shape, 4)
    for k in (0, 2):
        c[..., k] += c[..., 1] if sign > 0 else -c[..., 1]
    return out


def spread(blocks: np.ndarray, bits: int, shape: tuple[int, int]) -> np.ndarray:
    """A block image at the size of the picture."""
    return np.repeat(np.repeat(blocks, 1 << bits, axis=0), 1 << bits, axis=1)[: shape[0], : shape[1]]


def cross_colour(argb: np.ndarray, image: np.ndarray, bits: int, sign: int) -> np.ndarray:
    """Adds (or takes) the shares of green and red in red and blue that the block image tells."""
    m = np.ascontiguousarray(spread(image, bits, argb.shape)).view(np.int8).reshape(*argb.shape, 4).astype(np.int32)
    c = argb.view(np.int8).reshape(*argb.shape, 4).astype(np.int32)
    share = lambda by, of: (by * of) >> 5
    red = c[..., 2] + sign * share(m[..., 0], c[..., 1])
    known = (red if sign > 0 else c[..., 2]).astype(np.int8).astype(np.int32)
    blue = c[..., 0] + sign * (share(m[..., 1], c[..., 1]) + share(m[..., 2], known))
    out = argb.copy()
    o = out.view(np.uint8).reshape(*argb.shape, 4)
    o[..., 2], o[..., 0] = red & 255, blue & 255
    return out


def predicted(mode: np.ndarray, left: np.ndarray, top: np.ndarray, right: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Predictions of pixels, as int32 channels (n, 4), from their left, top, top-right and top-left neighbours."""
    half = lambda a, b: (a + b) >> 1
    out = np.zeros_like(left)
    for m in np.unique(mode):
        k = mode == m
        L, T, R, C = left[k], top[k], right[k], corner[k]
        if m == 0 or m > 13:
            p = np.zeros_like(L)
            p[:, 3] = 255
        elif m == 11:
            guess = L + T - C
            nearer = np.abs(guess - L).sum(axis=1, keepdims=True) < np.abs(guess - T).sum(axis=1, keepdims=True)
            p = np.where(nearer, L, T)
        elif m == 12:
            p = np.clip(L + T - C, 0, 255)
        elif m == 13:
            mean = half(L, T)
            diff = mean - C
            p = np.clip(mean + np.where(diff < 0, -(-diff // 2), diff // 2), 0, 255)
        else:
            p = {1: lambda: L, 2: lambda: T, 3: lambda: R, 4: lambda: C, 5: lambda: half(half(L, R), T), 6: lambda: half(L, C), 7: lambda: half(L, T), 8: lambda: half(C, T), 9: lambda: half(T, R), 10: lambda: half(half(L, C), half(T, R))}[int(m)]()
        out[k] = p
    return out


def predictions(c: np.ndarray, modes: np.ndarray, y: int, xs: np.ndarray) -> np.ndarray:
    """Predictions at (y, xs) with y > 0 and xs > 0; the pixel right of the last one in a row is the row's own first."""
    width = c.shape[1]
    flat = c.reshape(-1, 4)
    at = y * width + xs
    return predicted(modes[y, xs], flat[at - 1], flat[at - width], flat[at - width + 1], flat[at - width - 1])


def residuals(argb: np.ndarray, blocks: np.ndarray, bits: int) -> np.ndarray:
    height, width = argb.shape
    c = argb.view(np.uint8).reshape(height, width, 4).astype(np.int32)
    modes = spread(blocks, bits, argb.shape)
    out = c.copy()
    out[0, 0, 3] -= 255
    out[0, 1:] -= c[0, :-1]
    out[1:, 0] -= c[:-1, 0]
    for y in range(1, height):
        out[y, 1:] -= predictions(c, modes, y, np.arange(1, width))
    return (out & 255).astype(np.uint8).view(np.uint32).reshape(height, width)


def unpredicted(argb: np.ndarray, blocks: np.ndarray, bits: int) -> np.ndarray:
    """Adds the predictions. Rows whose modes look only upward, or only left, go at once; others pixel by pixel."""
    height, width = argb.shape
    modes = spread(blocks, bits, argb.shape)
    c = argb.view(np.uint8).reshape(height, width, 4).astype(np.int32)
    c[0, 0, 3] += 255
    c[0] = np.cumsum(c[0], axis=0) & 255
    for y in range(1, height):
        c[y, 0] = (c[y, 0] + c[y - 1, 0]) & 255
        row = set(np.unique(modes[y, 1:]).tolist())
        if row <= {0, 2, 3, 4, 8, 9, 14, 15}:
            xs = np.arange(1, width)
            c[y, 1:] = (c[y, 1:] + predictions(c, modes, y, xs)) & 255
        elif row == {1}:
            c[y] = np.cumsum(c[y], axis=0) & 255
        else:
            for x in range(1, width):
                c[y, x] = (c[y, x] + predictions(c, modes, y, np.array([x]))[0]) & 255
    return c.astype(np.uint8).view(np.uint32).reshape(height, width)


# Reading


class Table:
    """Symbol and length for the next ``bits`` bits of a prefix code; ``both`` has them in one number, the length in four bits."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if len(used) <= 1:
            self.bits, self.most = 0, int(used[0]) if len(used) else 0
            self.both = np.array([self.most << 4])
        else:
            found = lengths[used]
            by_length = np.argsort(found.astype(np.uint8), kind="stable")
            order, found = used[by_length], found[by_length]
            self.bits, self.most = int(found[-1]), int(used[-1])
            spans = 1 << (self.bits - found)
            if int(spans.sum()) != 1 << self.bits:
                raise ValueError("a prefix code is not complete")
            self.both = np.repeat(order << 4 | found, spans)[turned(self.bits)]
        self.size = self.both & 15

    @classmethod
    def simple(cls, symbols: list[int], alphabet: int) -> Table:
        lengths = np.zeros(max(alphabet, max(symbols) + 1), dtype=np.int64)
        lengths[symbols] = 1
        return table_of(lengths.tobytes())


@lru_cache(maxsize=32)
def table_of(lengths: bytes) -> Table:
    return Table(np.frombuffer(lengths, dtype=np.int64))


class BitReader:
    def __init__(self, data: bytes):
        self.words = np.frombuffer(data + b"\0" * 16, dtype=np.uint8)
        self.data, self.at, self.end = data + b"\0" * 16, 0, 8 * len(data)
        #: Features of the format that were met.
        self.used: set[str] = set()

    def bits(self, n: int) -> int:
        p = self.at
        if p + n > self.end:
            raise ValueError("the stream ends early")
        self.at = p + n
        return int.from_bytes(self.data[p >> 3 : (p >> 3) + 8], "little") >> (p & 7) & ((1 << n) - 1)

    def peek(self, at: int, n: int) -> int:
        """The ``n`` bits from a position on."""
        return int.from_bytes(self.data[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7) & ((1 << n) - 1)

    def symbol(self, table: Table) -> int:
        p = self.at
        k = int.from_bytes(self.data[p >> 3 : (p >> 3) + 4], "little") >> (p & 7) & ((1 << table.bits) - 1)
        both = int(table.both[k])
        self.at = p + (both & 15)
        if self.at > self.end:
            raise ValueError("the stream ends early")
        return both >> 4

    def windows(self, first: int, n: int) -> np.ndarray:
        """The 24 bits from each of ``n`` positions on."""
        a = first >> 3
        b = self.words[a : a + ceil_div(n, 8) + 5].astype(np.uint32)
        if len(b) < ceil_div(n, 8) + 5:
            b = np.concatenate([b, np.zeros(ceil_div(n, 8) + 5 - len(b), np.uint32)])
        four = b[:-4] | b[1:-3] << np.uint32(8) | b[2:-2] << np.uint32(16) | b[3:-1] << np.uint32(24)
        return (four.astype(np.int64)[:, None] >> np.arange(8)).ravel()[first & 7 :][:n]


def read_codes(r: BitReader, alphabets: tuple[int, ...]) -> list[Table]:
    """Codes one after another; one that is told by the same bits as the one before is the same, and not read again."""
    out: list[Table] = []
    told = size = 0
    for k, alphabet in enumerate(alphabets):
        if k and alphabets[k - 1] == alphabet and size > 64 and r.at + size <= r.end and r.peek(r.at, size) == told:
            out.append(out[-1])
            r.at += size
            continue
        first = r.at
        out.append(read_code(r, alphabet))
        size = r.at - first
        told = r.peek(first, size)
    return out


def read_code(r: BitReader, alphabet: int) -> Table:
    if r.bits(1):
        n = r.bits(1) + 1
        symbols = [r.bits(8 if r.bits(1) else 1)]
        if n == 2:
            symbols.append(r.bits(8))
        return Table.simple(symbols, alphabet)
    n = 4 + r.bits(4)
    outer = outer_of(n, r.bits(3 * n))
    most = alphabet
    if r.bits(1):
        n = 2 + 2 * r.bits(3)
        most = 2 + r.bits(n)
        if most > alphabet:
            raise ValueError("more code lengths than symbols")
    return table_of(read_lengths(r, outer, alphabet, most).tobytes())


@lru_cache(maxsize=32)
def outer_of(n: int, told: int) -> list[tuple[int, int]]:
    """Symbol and length for the next bits of the code that lengths are told by, whose own first ``n`` sizes take three bits each."""
    sizes = np.zeros(19, dtype=np.int64)
    sizes[list(LENGTH_ORDER[:n])] = [told >> 3 * k & 7 for k in range(n)]
    return [(x >> 4, x & 15) for x in Table(sizes).both.tolist()]


def read_lengths(r: BitReader, outer: list[tuple[int, int]], alphabet: int, most: int) -> np.ndarray:
    """The code lengths of an alphabet, told by at most ``most`` symbols; bits are taken from windows of a few hundred bytes."""
    mask = len(outer) - 1
    out, before, p, known = [], 8, r.at, r.at
    while len(out) < alphabet and most:
        if p + 32 > known:
            w, known = int.from_bytes(r.data[p >> 3 : (p >> 3) + 160], "little") >> (p & 7), p + 1272
        most -= 1
        s, n = outer[w & mask]
        w >>= n
        if s < 16:
            out.append(s)
            if s:
                before = s
        elif s == 16:
            out += [before] * (3 + (w & 3))
            w, n = w >> 2, n + 2
        elif s == 17:
            out += [0] * (3 + (w & 7))
            w, n = w >> 3, n + 3
        else:
            out += [0] * (11 + (w & 127))
            w, n = w >> 7, n + 7
        p += n
    if p > r.end:
        raise ValueError("the stream ends early")
    r.at = p
    if len(out) > alphabet:
        raise ValueError("more code lengths than symbols")
    lengths = np.zeros(alphabet, dtype=np.int64)
    lengths[: len(out)] = np.frombuffer(bytes(out), dtype=np.uint8)
    return lengths


def value_of(r: BitReader, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + r.bits(extra) + 1


def distance_of(code: int, width: int) -> int:
    """The first 120 codes name a neighbour, the others are plain distances."""
    if code > 120:
        return code - 120
    x, y = NEIGHBOURS[code - 1]
    return max(1, x + y * width)


def read_image(r: BitReader, width: int, height: int, main: bool) -> np.ndarray:
    """Pixels in reading order."""
    cache_bits = r.bits(4) if r.bits(1) else 0
    if cache_bits > 11:
        raise ValueError("a colour cache has at most 11 bits")
    if cache_bits:
        r.used.add("cache")
    groups, which, bits = 1, None, 0
    if main and r.bits(1):
        bits = r.bits(3) + 2
        r.used.add("groups")
        which = (read_image(r, ceil_div(width, 1 << bits), ceil_div(height, 1 << bits), False) >> 8 & 0xFFFF).reshape(ceil_div(height, 1 << bits), -1)
        groups = int(which.max()) + 1
    codes = [read_codes(r, (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)) for _ in range(groups)]
    if groups <= MOST_AT_ONCE:
        return read_at_once(r, codes, None if which is None else spread(which, bits, (height, width)).ravel(), width, width * height, cache_bits)
    return read_each(r, codes, which, bits, width, width * height, cache_bits)


def read_each(r: BitReader, codes: list[list[Table]], which: np.ndarray, bits: int, width: int, n: int, cache_bits: int) -> np.ndarray:
    """Symbol by symbol, with the codes of the pixel's block."""
    out, cache, at = [0] * n, [0] * (1 << cache_bits), 0
    while at < n:
        g, red, blue, alpha, dist = codes[int(which[at // width >> bits, at % width >> bits])]
        s = r.symbol(g)
        if s < 256:
            p = s << 8 | r.symbol(red) << 16
            p |= r.symbol(blue)
            p |= r.symbol(alpha) << 24
            new = [p]
        elif s < 280:
            length = value_of(r, s - 256)
            back = distance_of(value_of(r, r.symbol(dist)), width)
            if back > at or at + length > n:
                raise ValueError("a back-reference leaves the image")
            new = []
            for k in range(length):
                new.append(out[at - back + k] if k < back else new[k - back])
        else:
            new = [cache[s - 280]]
        for p in new:
            out[at] = p
            cache[(p * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0] = p
            at += 1
    return np.array(out, dtype=np.uint32)


def read_at_once(r: BitReader, codes: list[list[Table]], which: np.ndarray | None, width: int, n: int, cache_bits: int) -> np.ndarray:
    """Symbols are looked up for every bit of a block, for each group of codes, then the chain of pixels is followed.

    which: the group of each pixel, None if there is one group.
    """
    g, red, blue, alpha, _ = codes[0]
    if which is None and not any(t.bits for t in (g, red, blue, alpha)) and g.most < 256:
        return np.full(n, g.most << 8 | red.most << 16 | blue.most | alpha.most << 24, dtype=np.uint32)
    at, margin = 0, 160  # more bits than any pixel or back-reference takes
    told: list[tuple] = []  # green symbols, pixels and sizes of tokens, by block
    copies: list[tuple[int, int, int]] = []  # token, length, distance
    tokens, group_of = 0, None if which is None else which.tolist()
    while at < n:
        if r.at >= r.end:
            raise ValueError("the stream ends early")
        first, size = r.at, min(BLOCK_BITS, r.end - r.at + margin)
        win = r.windows(first, size + margin)
        span = min(size, len(win) - margin)
        greens, afters, follow, longs = [], [], [], {}
        for tables in codes:
            # How long each code's symbol would be at every bit; channels that share a code share this.
            both = tables[0].both.take(win & ((1 << tables[0].bits) - 1))
            for t in tables[1:4]:
                if t.bits and id(t) not in longs:
                    longs[id(t)] = t.size.take(win & ((1 << t.bits) - 1))
            green = both[:span] >> 4
            after_green = (both[:span] & 15) + np.arange(span)
            step = after_green.copy()
            for t in tables[1:4]:
                if t.bits:
                    step += longs[id(t)].take(step)
            if tables[0].most >= 256:
                np.copyto(step, after_green, where=green >= 280)
                np.putmask(step, (green - 256).view(np.uint64) < 24, -1)
            greens.append(green)
            afters.append(after_green)
            follow.append(memoryview(step))
        here, places, sizes, chosen, end_at = 0, [], [], [], at
        chain, keep = follow[0], places.append
        while end_at < n and here < span:
            to, counted = 0, len(places)
            try:
                if group_of is None:
                    for _ in range(n - end_at):
                        to = chain[here]
                        keep(here)
                        if to < 0:
                            break
                        here = to
                else:
                    for k in range(end_at, n):
                        to = follow[group_of[k]][here]
                        keep(here)
                        chosen.append(group_of[k])
                        if to < 0:
                            break
                        here = to
            except IndexError:  # the next pixel begins beyond this block
                pass
            end_at += len(places) - counted
            if to < 0:
                own = chosen[-1] if chosen else 0
                r.at = first + int(afters[own][here])
                length = value_of(r, int(greens[own][here]) - 256)
                back = distance_of(value_of(r, r.symbol(codes[own][4])), width)
                copies.append((tokens + len(places) - 1, length, back))
                r.used.add("copies")
                end_at += length - 1
                if back > end_at - length or end_at > n:
                    raise ValueError("a back-reference leaves the image")
                here = r.at - first
        r.at = first + here
        if r.at > r.end:
            raise ValueError("the stream ends early")
        k = np.array(places, dtype=np.int64)
        of = None if group_of is None else np.array(chosen, dtype=np.int64)
        symbols, pixels = np.empty(len(k), dtype=np.int64), np.empty(len(k), dtype=np.uint32)
        for own, (_, *tables, _) in enumerate(codes):
            mine = slice(None) if of is None else of == own
            p = k[mine]
            s = greens[own][p]
            x, q = s.astype(np.uint32) << np.uint32(8), afters[own][p]
            for t, shift in zip(tables, (16, 0, 24), strict=True):
                both = t.both.take(win[q] & ((1 << t.bits) - 1))
                x |= (both >> 4).astype(np.uint32) << np.uint32(shift)
                q = q + (both & 15)
            symbols[mine], pixels[mine] = s, x
        told.append((symbols, pixels))
        tokens += len(k)
        at = end_at
    symbols, pixels = told[0] if len(told) == 1 else (np.concatenate(x) for x in zip(*told, strict=True))
    return pixels if not copies and not cache_bits else resolved(symbols, pixels, copies, n, cache_bits)


def resolved(symbols: np.ndarray, pixels: np.ndarray, copies: list[tuple[int, int, int]], n: int, cache_bits: int) -> np.ndarray:
    """The image of literals, copies (token, length, distance) and cached colours (green symbols from 280 on).

    A copied pixel points to the one it repeats, a cached one to the last earlier one in its slot; pointers are followed to
    literals by halving what is left of the way, for all pixels at once.
    """
    token, length, back = np.array(copies, dtype=np.int64).reshape(-1, 3).T
    sizes = np.ones(len(symbols), dtype=np.int64)
    sizes[token] = length
    where = np.cumsum(sizes) - sizes
    literal = np.ones(len(symbols), dtype=bool)
    literal[token] = False
    hit = symbols >= 280
    literal &= ~hit
    out, to = np.zeros(n, dtype=np.uint32), np.arange(n)
    out[where[literal]] = pixels[literal]
    if len(token):
        copied = np.repeat(where[token] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
        to[copied] -= np.repeat(back, length)
        to = followed(to)
    if cache_bits and hit.any():
        slot = slots_of(out, cache_bits).astype(np.int64)
        known = where[hit]
        slot[known] = symbols[hit] - 280
        before = earlier(slot[to].astype(np.uint16))[known]
        if (before < 0).any():
            return one_by_one(symbols, pixels, copies, n, cache_bits)
        to[known] = before
        to = followed(to)
    return out[to]


def followed(to: np.ndarray) -> np.ndarray:
    """Every pointer's last goal; a goal points to itself."""
    while True:
        further = to[to]
        if (further == to).all():
            return to
        to = further


def one_by_one(symbols: np.ndarray, pixels: np.ndarray, copies: list[tuple[int, int, int]], n: int, cache_bits: int) -> np.ndarray:
    """``resolved`` for streams that ask the cache for a slot that nothing was put in, which holds 0."""
    out, cache, copied = [], [0] * (1 << cache_bits), {t: (m, d) for t, m, d in copies}
    for k, (s, p) in enumerate(zip(symbols.tolist(), pixels.tolist(), strict=True)):
        m, d = copied.get(k, (1, 0))
        for _ in range(m):
            out.append(out[-d] if d else cache[s - 280] if s >= 280 else p)
            cache[(out[-1] * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache_bits)] = out[-1]
    return np.array(out, dtype=np.uint32)


def decode(media: bytes, used: set[str] | None = None) -> np.ndarray:
    """The (height, width) array of 32-bit ARGB in a lossless WebP file. used: gets the features that the file has."""
    if len(media) < 20 or media[:4] != b"RIFF" or media[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    size = struct.unpack("<I", media[16:20])[0]
    r = BitReader(media[20 : 20 + size])
    if r.bits(8) != 0x2F:
        raise ValueError("not a lossless WebP stream")
    width, height = r.bits(14) + 1, r.bits(14) + 1
    r.bits(1)
    if r.bits(3):
        raise ValueError("unknown version")
    undo: list = []
    wide, seen = width, set()
    while r.bits(1):
        kind = r.bits(2)
        if kind in seen:
            raise ValueError("a transform comes twice")
        seen.add(kind)
        r.used.add(("predictor", "cross", "green", "palette")[kind])
        if kind == SUBTRACT_GREEN:
            undo.append(lambda x: add_green(x, 1))
        elif kind == PALETTE:
            n = r.bits(8) + 1
            parts = read_image(r, n, 1, False).view(np.uint8).reshape(n, 4)
            colours = np.zeros(256, dtype=np.uint32)
            colours[:n] = np.cumsum(parts, axis=0, dtype=np.uint8).copy().view(np.uint32).ravel()
            bits, whole = bundle_bits(n), wide
            wide = ceil_div(wide, 1 << bits)

            def unbundle(x: np.ndarray, colours=colours, bits=bits, whole=whole) -> np.ndarray:
                index = x >> 8 & 255
                if bits:
                    each = 8 >> bits
                    index = (index[:, :, None] >> (np.arange(1 << bits, dtype=np.uint32) * np.uint32(each)) & np.uint32((1 << each) - 1)).reshape(len(x), -1)[:, :whole]
                return colours[index]

            undo.append(unbundle)
        else:
            bits = r.bits(3) + 2
            image = read_image(r, ceil_div(wide, 1 << bits), ceil_div(height, 1 << bits), False).reshape(ceil_div(height, 1 << bits), -1)
            undo.append((lambda x, i=image, b=bits: unpredicted(x, i >> 8 & 15, b)) if kind == PREDICTOR else (lambda x, i=image, b=bits: cross_colour(x, i, b, 1)))
    argb = read_image(r, wide, height, True).reshape(height, wide)
    if used is not None:
        used |= r.used
    for f in reversed(undo):
        argb = f(argb)
    return argb


# Media columns


def padded(data: bytes) -> bytes:
    return data + b"\xff" * (-len(data) % UNIT if data else UNIT)


def pixels(payload: bytes) -> np.ndarray:
    """The picture of a padded payload: as many rows of 144 as needed, wider ones beyond 16384 rows.

    Where no width divides the payload, the last row is filled up with 255, which is not part of the payload.
    """
    units = len(payload) // UNIT
    widths = range(min(ceil_div(units, SIDE), SIDE // ROW), SIDE // ROW + 1)
    per_row = next((k for k in widths if units % k == 0), widths[0])
    c = np.frombuffer(payload + b"\xff" * (-units % per_row * UNIT), dtype="<u4")
    return exchanged(c).reshape(-1, ROW * per_row)


def payload(argb: np.ndarray) -> bytes:
    return exchanged(argb).tobytes()


def exchanged(x: np.ndarray) -> np.ndarray:
    """Four-byte pixels with the first and third bytes exchanged: red, green, blue, alpha to blue, green, red, alpha and back."""
    return x & np.uint32(0xFF00FF00) | x >> np.uint32(16) & np.uint32(0xFF) | (x & np.uint32(0xFF)) << np.uint32(16)


def media_of(data: bytes) -> bytes:
    return medias_of([data])[0]


def medias_of(rows: list[bytes]) -> list[bytes]:
    """The stored forms of texts: for each picture the smallest of the files that its features make likely.

    Every picture is encoded without a transform; a palette, another transform or groups are tried where estimates tell that
    they may take fewer bits. A picture of more rows than a file can have is several files, one after another.
    """
    files = [(k, image[y : y + SIDE]) for k, image in enumerate(map(pixels, map(padded, rows))) for y in range(0, len(image), SIDE)]
    made: list[bytes] = [b""] * len(files)
    for width in {f.shape[1] for _, f in files}:
        some = [n for n, (_, f) in enumerate(files) if f.shape[1] == width]
        images = [files[n][1] for n in some]
        for n, image, data, often, transforms, unlike in zip(some, images, *encode_all(images), transforms_for(images), mixed(images), strict=True):
            tried = [data, *(encode(image, t, shared=True, by_cost=True) for t in ((("palette",),) if often else (), transforms) if t)]
            groups = groups_for(image.ravel(), width, matches(image.ravel())) if unlike else None
            if groups is not None:
                tried.append(encode(image, shared=True, by_cost=True, groups=groups, group_bits=GROUP_BITS))
            made[n] = min(tried, key=len)
    out = [b""] * len(rows)
    for (k, _), data in zip(files, made, strict=True):
        out[k] += data
    return out


def decode_all(media: bytes, used: set[str] | None = None) -> np.ndarray:
    """The picture of ``media_of``: the files' rows in order."""
    parts, at = [decode(media, used)], 8 + int.from_bytes(media[4:8], "little")
    while media[at : at + 4] == b"RIFF":
        parts.append(decode(media[at:], used))
        at += 8 + int.from_bytes(media[at + 4 : at + 8], "little")
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def payload_size(n_bytes: int) -> int:
    """Bytes of the padded payload of a text."""
    return UNIT * max(1, ceil_div(n_bytes, UNIT))


@lru_cache(maxsize=64)
def bands(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the 72 parts of a payload begin, and their sizes."""
    edges = np.linspace(0, size, 73).astype(np.int64)
    return edges[:-1], np.diff(edges)


def feature_of(data: bytes) -> str:
    """64 bits of a difference hash (eight bands of the payload, nine means each) and the mean sample."""
    c = np.frombuffer(data, dtype=np.uint8)
    starts, sizes = bands(len(c))
    means = (np.add.reduceat(c, starts, dtype=np.int64) / sizes).reshape(8, 9)
    bits = means[:, 1:] > means[:, :-1]
    return np.packbits(bits).tobytes().hex() + f":{c.mean():.4f}"


def stored(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes ``doc_id, n_bytes, media`` as a table at ``path``; the media of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            raw = [x or b"" for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(medias_of(raw), pa.binary())], ["doc_id", "n_bytes", "media"])

    media = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("data")).mapInArrow(run, "doc_id long, n_bytes long, media binary")
    return written(media, path, compression="uncompressed")


DECODED = {"width": T.IntegerType(), "height": T.IntegerType(), "pixels": T.BinaryType(), "features": T.StringType()}


def pixel_arrays(df: DataFrame, media: str = "media", n_bytes: str | None = None, feature: str | None = None) -> DataFrame:
    """``df`` without ``media``, and with ``width, height, pixels, features``: decoded files of any lossless WebP encoder.

    pixels are red, green, blue and alpha bytes in reading order; features names what of the format the file uses. n_bytes
    names a column with the size of the text that was stored: pixels are cut to its padded payload, and a column called as
    ``feature`` says is added. A null file gives nulls; columns that are named like a result are replaced.
    """
    added = DECODED | ({feature: T.StringType()} if feature else {})
    kept = [c for c in df.columns if c != media and c not in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 32):
            rows: list[tuple] = []
            sizes = b.column(kept.index(n_bytes)).to_pylist() if n_bytes else [None] * b.num_rows
            for m, size in zip(b.column(len(kept)).to_pylist(), sizes, strict=True):
                if m is None:
                    rows.append((None,) * len(added))
                    continue
                used: set[str] = set()
                image = decode_all(m, used)
                data = payload(image)[: None if size is None else payload_size(size)]
                rows.append((image.shape[1], image.shape[0], data, "+".join(sorted(used)), *([feature_of(data)] if feature else [])))
            kinds = [pa.int32(), pa.int32(), pa.binary(), *[pa.string()] * (len(added) - 3)]
            yield pa.record_batch([*b.columns[:-1], *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], [*kept, *added])

    schema = T.StructType([*df.select(*kept).schema.fields, *(T.StructField(c, k) for c, k in added.items())])
    return df.select(*kept, F.col(media).alias("__media")).mapInArrow(run, schema)


def report(media: DataFrame) -> DataFrame:
    """Reads stored media back as pixel arrays, and reduces each to its digests and feature; Spark digests what Python decoded."""
    told = media.select("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    arrays = pixel_arrays(told, n_bytes="n_bytes", feature="feature")
    size = F.octet_length("pixels")
    digests = [size.cast("long").alias("payload_bytes"), F.sha2("pixels", 256).alias("payload_sha256"), F.crc32(F.substring("pixels", -32, 32)).alias("tail_crc32")]
    return arrays.select("doc_id", "n_bytes", *digests, "media_bytes", "media_sha256", "width", "height", "feature", "features")


def media_report(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores every text as media in the shared folder and reports what is read back."""
    return report(stored(df, f"{shared_dir(df.sparkSession)}/media", key, text))
