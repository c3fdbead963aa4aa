import hashlib
import zlib

import numpy as np
import pytest

from prismark.llm import webp


def picture(rng, height, width, colours=None):
    if colours:
        table = rng.integers(0, 1 << 32, colours, dtype=np.uint32)
        return table[rng.integers(0, colours, (height, width))]
    base = rng.integers(0, 1 << 32, (height, width), dtype=np.uint32)
    base[rng.random((height, width)) < 0.4] = 0xFF102030
    base[height // 2 :] &= 0xFF0F0F0F
    return base


def blocks(rng, height, width, bits, high, depth=None):
    shape = (webp.ceil_div(height, 1 << bits), webp.ceil_div(width, 1 << bits))
    return rng.integers(-high if depth else 0, high, (*shape, depth) if depth else shape)


@pytest.mark.parametrize("shape", [(1, 1), (1, 7), (9, 1), (13, 17), (40, 33)])
@pytest.mark.parametrize("cache", [0, 1, 5, 11])
def test_plain_and_cache(shape, cache):
    rng = np.random.default_rng(sum(shape) + cache)
    for colours in (None, 1, 2, 3, 30):
        image = picture(rng, *shape, colours)
        assert (webp.decode(webp.encode(image, cache_bits=cache)) == image).all()


@pytest.mark.parametrize("mode", [*range(14), None])
def test_predictor(mode):
    rng = np.random.default_rng(5)
    image = picture(rng, 21, 19)
    b = blocks(rng, 21, 19, 2, 14) if mode is None else np.full((6, 5), mode)
    assert (webp.decode(webp.encode(image, (("predictor", 2, b),))) == image).all()


def test_cross_colour_green_and_all_together():
    rng = np.random.default_rng(6)
    image = picture(rng, 30, 26)
    cross = ("cross", 3, blocks(rng, 30, 26, 3, 127, 3))
    for transforms in ((cross,), (("green",),), (("predictor", 3, blocks(rng, 30, 26, 3, 14)), cross, ("green",))):
        assert (webp.decode(webp.encode(image, transforms, cache_bits=4)) == image).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 200])
def test_palette(colours):
    rng = np.random.default_rng(colours)
    image = picture(rng, 15, 22, colours)
    assert (webp.decode(webp.encode(image, (("palette",),))) == image).all()
    assert (webp.decode(webp.encode(image, (("palette",), ("green",)), cache_bits=2)) == image).all()


def test_subtract_green_by_hand():
    image = np.array([[0xFF112233]], dtype=np.uint32)
    assert hex(int(webp.add_green(image, -1)[0, 0])) == "0xffef2211"


def test_symbol_by_symbol_agrees():
    """One picture's stream, read with one group at once and with the same group symbol by symbol."""
    rng = np.random.default_rng(8)
    image = picture(rng, 16, 24)
    image[5:9] = 0xFF00FF00
    for cache in (0, 3):
        w = webp.BitWriter()
        webp.put_image(w, image.ravel(), True, cache, 24)
        data = w.bytes()
        a = webp.read_image(webp.BitReader(data), 24, 16, True)
        r = webp.BitReader(data)
        n = r.bits(4) if r.bits(1) else 0
        assert not r.bits(1)
        codes = [[webp.read_code(r, k) for k in (280 + (1 << n if n else 0), 256, 256, 256, 40)]]
        b = webp.read_each(r, codes, np.zeros((16, 24), np.int64), 0, 24, 16 * 24, n)
        assert (a == image.ravel()).all() and (b == image.ravel()).all()


def test_groups_by_entropy_image():
    """Two groups of codes, written by hand: the left block holds one colour, the right one another."""
    w = webp.BitWriter()
    w.put(0, 1)
    w.put(1, 1)
    w.put(0, 3)  # blocks of 4
    webp.put_image(w, np.array([0xFF000000, 0xFF000100], dtype=np.uint32), False)
    for green in (10, 20):
        for symbol, n in ((green, 280), (1, 256), (2, 256), (255, 256), (0, 40)):
            webp.put_code(w, np.bincount([symbol], minlength=n))
    out = webp.read_image(webp.BitReader(w.bytes()), 8, 2, True).reshape(2, 8)
    assert (out[:, :4] == 0xFF010A02).all() and (out[:, 4:] == 0xFF011402).all()


def text(rng, n, words=400):
    """Bytes like those of documents: words of letters, some of them often, and a repeated line."""
    known = ["".join(rng.choice(list("etaoinshr"), rng.integers(2, 9))) for _ in range(words)]
    line = " ".join(rng.choice(known, 30))
    return f"{line}\n{' '.join(rng.choice(known, n))}\n{line}\n".encode()


def test_encode_all_makes_the_same_files():
    rng = np.random.default_rng(11)
    rows = [b"", b"a", text(rng, 40), text(rng, 900), bytes(rng.integers(0, 256, 5000, dtype=np.uint8)), text(rng, 40) * 3]
    images = [webp.pixels(webp.padded(x)) for x in rows]
    together, often = webp.encode_all(images)
    assert often.tolist() == [False] * 6
    for image, data in zip(images, together, strict=True):
        assert data == webp.encode(image, shared=True, by_cost=True)
        assert (webp.decode(data) == image).all()


def test_features_are_chosen_by_cost():
    """What a picture gains from, it uses: cache and copies on text, a palette, a predictor, cross-colour, groups."""
    rng = np.random.default_rng(12)
    smooth = np.cumsum(np.cumsum(rng.integers(-1, 2, (40, 576)), axis=1), axis=0) // 8 % 256
    green = rng.integers(0, 120, 9000)
    shifted = np.stack([green // 2 + rng.integers(0, 3, 9000), green, green // 2 * 0 + 7, np.full(9000, 9)], axis=1) % 256
    mixed = np.concatenate([rng.integers(97, 105, 23040), rng.integers(160, 168, 23040)])
    rows = {
        "cache": text(rng, 2000, 30),
        "copies": text(rng, 50) * 2,
        "palette": b"".join(rng.choice([b"\x01abc", b"zq\x07~", b"!?!\x90", b"\xff\x00 h"], 1440).tolist()),
        "predictor": smooth.astype(np.uint8).tobytes(),
        "cross": shifted.astype(np.uint8).tobytes(),
        "groups": mixed.astype(np.uint8).tobytes(),
    }
    media = webp.medias_of(list(rows.values()))
    assert media == [webp.media_of(x) for x in rows.values()]  # whatever stands beside a text
    for (name, raw), data in zip(rows.items(), media, strict=True):
        used = set()
        assert webp.payload(webp.decode_all(data, used))[: webp.payload_size(len(raw))] == webp.padded(raw)
        assert name in used or (name == "cross" and "green" in used), (name, used)


@pytest.mark.parametrize("cache", [1, 4, 6, 11])
def test_pointers_agree_with_one_by_one(cache):
    """Random streams of literals, overlapping copies and cached colours, and slots that nothing was put in."""
    rng = np.random.default_rng(cache)
    for empty in (False, True):
        n, copies, symbols, pixels, filled = 0, [], [], [], []
        colours = rng.integers(0, 1 << 32, 40, dtype=np.uint32)
        for k in range(600):
            kind = rng.integers(0, 4) if filled else 3
            pixels.append(colours[rng.integers(0, 40)])
            if kind == 0:
                copies.append((k, int(rng.integers(1, 30)), int(rng.integers(1, n + 1))))
                symbols.append(260)
                n += copies[-1][1]
            else:
                n += 1
                if kind == 1:
                    symbols.append(280 + (int(rng.integers(0, 1 << cache)) if empty else filled[rng.integers(0, len(filled))]))
                else:
                    symbols.append(5)
                    filled.append(int(webp.slots_of(pixels[-1:] * np.ones(1, np.uint32), cache)[0]))
        a = webp.resolved(np.array(symbols), np.array(pixels, dtype=np.uint32), copies, n, cache)
        b = webp.one_by_one(np.array(symbols), np.array(pixels, dtype=np.uint32), copies, n, cache)
        assert (a == b).all()


def test_groups_at_once_and_each():
    rng = np.random.default_rng(13)
    image = picture(rng, 37, 45)
    groups = rng.integers(0, 3, (10, 12))
    groups[0, :3] = 0, 1, 2
    for cache in (0, 3):
        data = webp.encode(image, cache_bits=cache, groups=groups, group_bits=2)
        assert (webp.decode(data) == image).all()
        most, webp.MOST_AT_ONCE = webp.MOST_AT_ONCE, 1
        try:
            assert (webp.decode(data) == image).all()
        finally:
            webp.MOST_AT_ONCE = most


# Streams made by hand, bit by bit, after the format's description


class Bits:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, *pairs):
        """(value, bits), lowest bit first."""
        for value, bits in pairs:
            self.value |= value << self.n
            self.n += bits
        return self

    def code(self, *bits):
        """A prefix code's bits, first bit first."""
        return self.put(*((b, 1) for b in bits))

    def only(self, symbol):
        """A simple code with one symbol of eight bits."""
        return self.put((1, 1), (0, 1), (1, 1), (symbol, 8))

    def file(self):
        data = self.value.to_bytes((self.n + 7) // 8, "little")
        data += b"\0" * (len(data) % 2)
        return b"RIFF" + (len(data) + 12).to_bytes(4, "little") + b"WEBPVP8L" + len(data).to_bytes(4, "little") + data


def head(width, height):
    return Bits().put((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3))


def flat(bits, green, red, blue, alpha):
    """An image of one colour: every code has one symbol; the distance code as well."""
    return bits.only(green).only(red).only(blue).only(alpha).only(0)


def average(a, b):
    return [(x + y) // 2 for x, y in zip(a, b, strict=True)]


def guess(mode, left, top, right, corner):
    """The format's fourteen predictions, channel by channel."""
    clamp = lambda v: max(0, min(255, v))
    if mode == 11:
        near = [sum(abs(l + t - c - x) for l, t, c, x in zip(left, top, corner, side, strict=True)) for side in (left, top)]
        return left if near[0] < near[1] else top
    if mode == 13:
        mean = average(left, top)
        return [clamp(m + int((m - c) / 2)) for m, c in zip(mean, corner, strict=True)]
    return {
        0: [255, 0, 0, 0], 1: left, 2: top, 3: right, 4: corner, 5: average(average(left, right), top), 6: average(left, corner), 7: average(left, top), 8: average(corner, top),
        9: average(top, right), 10: average(average(left, corner), average(top, right)), 12: [clamp(l + t - c) for l, t, c in zip(left, top, corner, strict=True)],
    }[mode]


@pytest.mark.parametrize("mode", range(14))
def test_predictor_by_hand(mode):
    """All residuals are (alpha 0, red 40, green 90, blue 201); pixels follow from the predictions alone."""
    bits = head(5, 4).put((1, 1), (0, 2), (0, 3), (0, 1))  # the predictor, blocks of 4 pixels, no cache
    flat(bits, mode, 0, 0, 0).put((0, 1), (0, 1), (0, 1))  # no more transforms, no cache, one group
    data = flat(bits, 90, 40, 201, 0).file()
    out = {}
    for y in range(4):
        for x in range(5):
            near = [out.get(p) for p in ((x - 1, y), (x, y - 1), (x + 1, y - 1) if x < 4 else (0, y), (x - 1, y - 1))]
            p = [255, 0, 0, 0] if not x and not y else near[0] if not y else near[1] if not x else guess(mode, *near)
            out[x, y] = [(v + d) % 256 for v, d in zip(p, (0, 40, 90, 201), strict=True)]
    want = [[int.from_bytes(bytes(out[x, y]), "big") for x in range(5)] for y in range(4)]
    assert webp.decode(data).tolist() == want


def test_cross_colour_by_hand():
    """green to red 64 (twice), green to blue -32 (minus once), red to blue 16 (half), on green 10, red 3, blue 50."""
    bits = head(3, 2).put((1, 1), (1, 2), (0, 3), (0, 1))
    flat(bits, (-32) % 256, 16, 64, 255).put((0, 1), (0, 1), (0, 1))
    used = set()
    got = webp.decode(flat(bits, 10, 3, 50, 200).file(), used)
    assert (got == (200 << 24 | 23 << 16 | 10 << 8 | (50 - 10 + 11))).all() and used == {"cross"}


def test_green_and_palette_by_hand():
    bits = head(2, 1).put((1, 1), (2, 2), (0, 1), (0, 1), (0, 1))
    assert (webp.decode(flat(bits, 100, 200, 7, 9).file()) == (9 << 24 | (300 - 256) << 16 | 100 << 8 | 107)).all()
    # A palette of three colours, each (1, 2, 3, 4) more than the one before; four pixels of two bits in a byte: 0 1 2 0, 2 1.
    bits = head(6, 1).put((1, 1), (3, 2), (2, 8), (0, 1))
    flat(bits, 3, 2, 4, 1).put((0, 1), (0, 1), (0, 1))
    bits.put((1, 1), (1, 1), (1, 1), (0b00100100, 8), (0b0110, 8)).only(0).only(0).only(255).only(0).put((1, 1), (0, 1))
    colour = lambda k: k << 24 | 2 * k << 16 | 3 * k << 8 | 4 * k
    # Of two symbols the smaller one is the code 0, so the bits 1 and 0 are the first byte and the second.
    assert webp.decode(bits.file()).tolist() == [[colour(k) for k in (1, 2, 3, 1, 3, 2)]]


def test_cache_and_back_reference_by_hand():
    """A literal, the cache's slot of it, a copy of length 3 from the pixel to the left, a literal, the slot again."""
    first, second = 0xFF005A00, 0xFF006700
    assert [(x * 0x1E35A7BD & 0xFFFFFFFF) >> 30 for x in (first, second)] == [0, 3]
    bits = head(7, 1).put((0, 1), (1, 1), (2, 4), (0, 1))  # no transform, a cache of two bits, one group
    # Of green's 284 symbols 90, 103, 258 (a length of 3) and 280 (the slot 0) have two bits each. The lengths are told by
    # a code in which 18 has one bit, 2 and 17 have two: 0, 10, 11.
    bits.put((0, 1), (5 - 4, 4), (2, 3), (1, 3), (0, 3), (0, 3), (2, 3), (0, 1))
    zeros = lambda n: bits.code(1, 1).put((n - 3, 3)) if n <= 10 else bits.code(0).put((n - 11, 7))
    two = lambda: bits.code(1, 0)
    zeros(90), two(), zeros(12), two(), zeros(138), zeros(16), two(), zeros(21), two(), zeros(3)
    bits.only(0).only(0).only(255).only(1)  # red, blue, alpha, and the second distance code: the pixel to the left
    bits.code(0, 0).code(1, 1).code(1, 0).code(0, 1).code(1, 1)
    used = set()
    assert webp.decode(bits.file(), used).tolist() == [[first, first, first, first, first, second, first]] and used == {"cache", "copies"}


def test_two_dimensional_distances():
    assert [webp.distance_of(k, 100) for k in (1, 2, 3, 4, 5, 120, 121, 130)] == [100, 1, 101, 99, 200, 708, 1, 10]
    assert webp.distance_of(4, 1) == 1
    for v in [*range(1, 70), 1000, 4096, 1 << 19]:
        s, extra, low = webp.prefix_of(v)
        w = webp.BitWriter()
        w.put(low, extra)
        w.put(0, 1)
        assert webp.value_of(webp.BitReader(w.bytes()), s) == v


def test_blocks_of_bits(monkeypatch):
    rng = np.random.default_rng(3)
    image = picture(rng, 60, 50)
    data = webp.encode(image)
    monkeypatch.setattr(webp, "BLOCK_BITS", 777)
    assert (webp.decode(data) == image).all()


@pytest.mark.parametrize("cut", [0, 10, 19, 25, 40])
def test_damage_is_an_error(cut):
    rng = np.random.default_rng(2)
    data = webp.encode(rng.integers(0, 1 << 32, (20, 20), dtype=np.uint32))
    with pytest.raises(ValueError):
        webp.decode(data[:cut])


def test_query(spark):
    texts = [None, "", "a", "é" * 287, "é" * 288, "x" * 577, "word " * 40_000, "".join(map(chr, range(32, 3000)))]
    df = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts + texts)], "doc_id long, text string, media string")
    got = {r.doc_id: r for r in webp.media_report(df).collect()}
    assert len(got) == 2 * len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        p = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert tuple(got[i + len(texts)])[1:] == tuple(r)[1:]
    assert webp.media_report(df.limit(0)).count() == 0


def test_pixel_arrays(spark):
    data = webp.media_of(b"hello")
    rows = [(1, bytearray(data), 5, 0), (2, None, None, 1), (3, bytearray(webp.encode(np.array([[1, 2]], dtype=np.uint32))), None, 2)]
    df = spark.createDataFrame(rows, "doc_id long, media binary, n_bytes long, width long")
    row = webp.pixel_arrays(df).orderBy("doc_id").collect()
    assert row[0].asDict().keys() == {"doc_id", "n_bytes", "width", "height", "pixels", "features"}
    assert bytes(row[0].pixels) == webp.padded(b"hello") and (row[0].width, row[0].height) == (144, 1)
    assert row[1].pixels is None and row[1].width is None
    assert bytes(row[2].pixels) == bytes([0, 0, 1, 0, 0, 0, 2, 0])
    cut = webp.pixel_arrays(df, n_bytes="n_bytes", feature="f").orderBy("doc_id").collect()
    assert cut[0].f == webp.feature_of(webp.padded(b"hello")) and cut[1].f is None


@pytest.mark.parametrize("units", [16384, 16385, 16411, 16412, 113 * 200 + 1, 32771])
def test_any_number_of_units_fits(units):
    """16,411 and 32,771 are primes: no width divides them."""
    raw = np.arange(units * webp.ROW, dtype=np.uint32).tobytes()
    image = webp.pixels(raw)
    assert max(image.shape) <= webp.SIDE and webp.payload(image)[: len(raw)] == raw
    assert set(webp.payload(image)[len(raw) :]) <= {255}


def test_a_picture_of_several_files(monkeypatch):
    monkeypatch.setattr(webp, "SIDE", 300)
    for units in (599, 600, 601, 1205, 1801):
        raw = b"".join(b"%d " % k for k in range(units * 120))[: units * webp.UNIT - 5]
        media = webp.media_of(raw)
        assert media.count(b"RIFF") == -(-units // 600)
        assert webp.payload(webp.decode_all(media))[: webp.payload_size(len(raw))] == webp.padded(raw)


def test_query_of_a_very_long_text(spark):
    """A text of 16,411 units beside others: no row is lost and its payload has no filling."""
    long = "word \u00e9" * (16_411 * 576 // 7)
    texts = ["a", long, None]
    got = {r.doc_id: r for r in webp.media_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(got) == 3
    p = webp.padded(long.encode())
    assert len(p) == 16_411 * 576
    r = got[1]
    assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature) == (len(long.encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), webp.feature_of(p))
    assert max(r.width, r.height) <= webp.SIDE


def test_codes_are_read_in_few_steps(monkeypatch):
    """What the encoder tells of a code is read back; the sizes of the code that tells lengths are one number, not a call each."""
    rng, calls, bits = np.random.default_rng(11), 0, webp.BitReader.bits

    def counted(r, n):
        nonlocal calls
        calls += 1
        return bits(r, n)

    monkeypatch.setattr(webp.BitReader, "bits", counted)
    for alphabet in (40, 256, 280, 344, 280 + 2048):
        for some in (3, 7, 60, alphabet):
            counts = np.zeros(alphabet, dtype=np.int64)
            start = int(rng.integers(0, max(1, alphabet - 2 * some)))
            counts[start : start + 2 * some : 2] = 1 << rng.integers(0, 14, len(counts[start : start + 2 * some : 2]))
            counts[-1] += 1
            value, size, code = webp.code_of(counts.tobytes())
            r = webp.BitReader(value.to_bytes(size // 8 + 1, "little"))
            calls = 0
            table = webp.read_code(r, alphabet)
            assert r.at == size and calls <= 4
            for k in np.flatnonzero(counts).tolist():
                w = webp.BitReader(int(code.bits[k]).to_bytes(4, "little"))
                assert w.symbol(table) == k and w.at == code.sizes[k]
