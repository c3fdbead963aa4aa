import random

import numpy as np
import pytest

from prismark.kernels import blake3, cdc, codec, codes, dct, jcs, minhash, sequences, simhash, text, xxh32
from prismark.tables import MERSENNE, MINHASH_A, MINHASH_B, gear

UNITS = ["AAAYPXW445FTYNJ3", "EAARMJLTQCUWAND2", "GABVVC5DMJJGYKZ4ZBYVNYABFFYXG", "IADWIK7A7JTUAQ2D6QARX7OBEIK3OOUAM42LOBLCZ4ZOGDLRHMDL6TQ"]


@pytest.mark.parametrize(
    ("args", "iscc"),
    [
        (("Die Unendliche Geschichte",), "ISCC:AAAZXZ6OU74YAZIM"),
        (("Die Unendliche Geschichte", "Von Michael Ende"), "ISCC:AAAZXZ6OU4E45RB5"),
        (("Hello", None, '{"some":"object"}'), "ISCC:AAAWKLHFXN63LHL2"),
        (("Hello", None, "data:application/json;charset=utf-8;base64,eyJzb21lIjogIm9iamVjdCJ9"), "ISCC:AAAWKLHFXN43ICP2"),
        (("Test", None, '{"value":1.0}'), "ISCC:AAAX4GX3RZH2I6QZ"),
        (("Test", None, '{"value":1e20}'), "ISCC:AAAX4GX3R32YH5P7"),
    ],
)
def test_meta(args, iscc):
    assert codes.meta_code(*args)["iscc"] == iscc


def test_meta_fields():
    r = codes.meta_code("Test", None, '{"value":1.0}')
    assert r["meta"] == "data:application/json;base64,eyJ2YWx1ZSI6MX0="
    assert r["metahash"] == "1e2010b291d392b6999ffe4aa4661fb343fc371fca3bfb5bb4e8d8226fdf85743232"
    r = codes.meta_code("Test", None, '{"value":1e20}')
    assert r["meta"].endswith("eyJ2YWx1ZSI6MTAwMDAwMDAwMDAwMDAwMDAwMDAwfQ==")
    assert r["metahash"] == "1e201ff83c1822c348717658a0b4713739646da7c59832691b337a457416ddd1c73d"
    r = codes.meta_code("Test", "ignored for the digest", "data:application/json;base64,")
    assert r["metahash"] == codes.multihash(b"") and r["iscc"] == codes.meta_code("Test")["iscc"]
    assert r["description"] == "ignored for the digest" and r["meta"] == "data:application/json;base64,"


@pytest.mark.parametrize("args", [("",), (" \n",), ("a", None, "no json"), ("a", None, ""), ("a", None, "data:no-comma-here"), ("a", None, "data:x," + "A" * 3), ("a", None, "x" * 170_923), ("a", None, '"' + "x" * 128_000 + '"'), ("a", None, "NaN")])
def test_meta_errors(args):
    with pytest.raises(ValueError):
        codes.meta_code(*args)


def test_text_image_audio_data_instance():
    assert codes.text_codes(["", "Hello World"]) == [{"iscc": "ISCC:EAASL4F2WZY7KBXB", "characters": 0}, {"iscc": "ISCC:EAASKDNZNYGUUF5A", "characters": 10}]
    assert codes.image_code(bytes(1024))["iscc"] == "ISCC:EEAQAAAAAAAAAAAA"
    assert codes.image_code(b"\xff" * 1024, 128)["iscc"] == "ISCC:EEBYAAAAAAAAAAAAAAAAAAAAAAAAA"
    assert codes.audio_code([])["iscc"] == "ISCC:EIAQAAAAAAAAAAAA"
    assert codes.audio_code([1], 128)["iscc"] == "ISCC:EIBQAAAAAEAAAAABAAAAAAAAAAAAA"
    assert codes.audio_code([-1, 0, 1], 256)["iscc"] == "ISCC:EIDQAAAAAH777777AAAAAAAAAAAACAAAAAAP777774AAAAAAAAAAAAI"
    assert codes.data_code(b"\xff\x00")["iscc"] == "ISCC:GAAXL2XYM5BQIAZ3"
    r = codes.instance_code(b"")
    assert r == {"iscc": "ISCC:IAA26E2JXH27TING", "datahash": "1e20af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262", "filesize": 0}
    assert codes.multihash(b"hello world") == "1e20d74981efa70a0c880b8d8c1985d075dbcbf679b99a5f9914e5aaf96b831a9e24"


def test_text_codes_do_not_depend_on_their_batch():
    texts = ["", "abc", "The quick brown fox jumps over the lazy dog. " * 200, "日本語テキスト" * 9, "é" * 40, "Ünï cödé\n" * 50]
    together = codes.text_codes(texts, 256)
    assert together == [codes.text_codes([t], 256)[0] for t in texts]
    features = [xxh32.of(g.encode()) for g in text.ngrams(text.collapse(texts[5]), 13)]
    low = [min((a * f + b) % 2**64 % MERSENNE & 0xFFFFFFFF for f in features) for a, b in zip(MINHASH_A, MINHASH_B, strict=True)]
    bits = "".join(str(m >> k & 1) for k in range(4) for m in low)
    assert codec.decoded(together[5]["iscc"])[4] == int(bits, 2).to_bytes(32, "big")


@pytest.mark.parametrize(
    ("f", "given", "wanted"),
    [
        (text.clean, "hello\tworld", "helloworld"), (text.clean, "hello\nworld", "hello\nworld"), (text.clean, "a\n\n\nb", "a\n\nb"), (text.clean, "  hello  ", "hello"),
        (text.clean, "a\r\nb", "a\nb"), (text.clean, "", ""), (text.clean, "ℍ", "H"), (text.clean, "a\n \n\t\nb", "a\n \nb"),
        (text.remove_newlines, "hello\nworld", "hello world"), (text.remove_newlines, "a  b   c", "a b c"), (text.remove_newlines, " a\x1cb ", "a\x1cb"),
        (text.collapse, "Hello World", "helloworld"), (text.collapse, "café", "cafe"), (text.collapse, "hello, world!", "helloworld"), (text.collapse, "", ""), (text.collapse, "a$b~c", "a$b~c"),
    ],
)
def test_text_utilities(f, given, wanted):
    assert f(given) == wanted


@pytest.mark.parametrize(("s", "n", "wanted"), [("hello", 10, "hello"), ("hello", 5, "hello"), ("hello world", 5, "hello"), ("é", 1, ""), ("hello ", 6, "hello"), ("aé", 2, "a"), ("日本", 5, "日")])
def test_trim(s, n, wanted):
    assert text.trim(s, n) == wanted


def test_ngrams():
    assert text.ngrams("hello", 3) == ["hel", "ell", "llo"]
    assert text.ngrams("ab", 5) == ["ab"] and text.ngrams("", 3) == [""] and text.ngrams("你好世界", 2) == ["你好", "好世", "世界"]
    with pytest.raises(ValueError, match="2 or bigger"):
        text.ngrams("abc", 1)


def test_simhash_minhash_xxh32():
    assert simhash.simhash([]) == bytes(32) and simhash.simhash([b"\x12" * 32]) == b"\x12" * 32
    assert simhash.simhash([b"\xff" * 32, bytes(32)]) == b"\xff" * 32
    with pytest.raises(ValueError):
        simhash.simhash([b"a", b"ab"])
    assert minhash.digest(np.zeros(0, np.uint32)) == b"\xff" * 32
    assert xxh32.of(b"") == 0x02CC5D05
    xxhash = pytest.importorskip("xxhash")
    rng = random.Random(4)
    for n in [*range(70), 100, 1000, 1001]:
        raw = rng.randbytes(n)
        assert xxh32.of(raw) == xxhash.xxh32_intdigest(raw)


def test_minima_of_many_sets(monkeypatch):
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 300, 40)
    features, starts = rng.integers(0, 1 << 32, sizes.sum(), dtype=np.uint32), np.cumsum(sizes) - sizes
    each = np.concatenate([minhash.minima(features[a : a + n], np.zeros(1, np.int64)) for a, n in zip(starts, sizes, strict=True)])
    assert (minhash.minima(features, starts) == each).all()
    monkeypatch.setattr(minhash, "STEP", 64)
    assert (minhash.minima(features, starts) == each).all()


def plain_cuts(data, average, utf32):
    s, table, out, at = cdc.Sizes.of(average), gear().tolist(), [], 0
    while at < len(data):
        size = len(data) - at
        n, pattern, end = min(s.least, size), 0, None
        for stop, mask in ((s.centre, s.strict), (s.most, s.loose)):
            while end is None and n < min(stop, size):
                pattern = ((pattern >> 1) + table[data[at + n]]) & 0xFFFFFFFF
                n += 1
                if pattern & mask == 0:
                    end = n
        end = n if end is None else end
        if utf32:
            end = end - end % 4 or min(size, 4)
        at += end
        out.append(at)
    return out or [0]


@pytest.mark.parametrize("average", [2, 16, 64, 256, 1024, 4096])
@pytest.mark.parametrize("utf32", [False, True])
def test_chunks(average, utf32):
    rng = random.Random(average)
    for data in (rng.randbytes(20_000), b"*" * 9_000, bytes(i % 256 for i in range(10_000)), b"ab" * 30, b"x"):
        assert cdc.cuts(data, utf32, average) == plain_cuts(data, average, utf32)
        assert b"".join(cdc.split(data, utf32, average)) == data


def test_chunk_edges():
    assert cdc.split(b"") == [b""] and cdc.split(bytes([42]) * 100) == [bytes([42]) * 100]
    s = cdc.Sizes.of(1024)
    assert (s.least, s.most, s.centre, s.strict, s.loose) == (256, 8192, 640, 2047, 511)
    for n in (0, 1):
        with pytest.raises(ValueError):
            cdc.split(b"abc", average=n)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1023, 1024, 1025, 2048, 3073, 8192, 31_744, 100_000])
def test_blake3_in_pieces(n):
    data = bytes(i % 251 for i in range(n))
    whole = blake3.digest(data)
    for step in (1, 256, 1024, 4096) if n <= 3073 else (1000, 4096):
        h = blake3.Hasher()
        for i in range(0, n, step):
            h.update(data[i : i + step])
        assert h.digest() == whole
    assert blake3.digests([data, b"", data])[0] == whole


def test_blake3_in_long_pieces():
    """Subtrees of a piece merge a level at a time, not a chunk at a time."""
    data, calls = random.Random(4).randbytes(300_000), []
    h, one = blake3.Hasher(), blake3.parents
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(blake3, "parents", lambda cvs, root=False: calls.append(len(cvs)) or one(cvs, root))
        at = 0
        for n in (0, 1024, 5000, 100_001, 1, 70_000, 300_000):
            h.update(data[at : at + n])
            at += n
        assert h.digest() == blake3.digest(data)
    assert len(calls) < 60


def test_blake3_known():
    """Vectors of the specification: bytes 0, 1, ... modulo 251."""
    assert blake3.digest(b"\0").hex() == "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213"
    assert blake3.digest(b"abc").hex() == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"


@pytest.mark.parametrize("step", [1, 256, 1024, 4096])
def test_hashers(step):
    data = random.Random(step).randbytes(10_000)
    d, i = codes.DataHasher(), codes.InstanceHasher()
    for k in range(0, len(data), step):
        d.update(data[k : k + step])
        i.update(data[k : k + step])
    assert d.finalize() == codes.data_code(data) and i.finalize() == codes.instance_code(data)
    for h in (d, i):
        with pytest.raises(ValueError, match="already finalized"):
            h.finalize()
        with pytest.raises(ValueError, match="already finalized"):
            h.update(b"")
    assert codes.DataHasher().finalize() == codes.data_code(b"")


def test_dct():
    assert np.allclose(dct.dct(np.array([1.0, 2, 3, 4])), [10, -3.15432202989895, 0, -0.22417076458398263], atol=1e-10)
    assert dct.dct(np.full(32, 255.0)).tolist() == [8160.0] + [0.0] * 31
    for n in (0, 3, 6, 10, 12):
        with pytest.raises(ValueError):
            dct.dct(np.zeros(n))
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (4, 1024))
    basis = np.cos(np.pi * np.outer(np.arange(32), np.arange(32) + 0.5) / 32)
    grid = basis @ x.reshape(4, 32, 32) @ basis.T
    block = grid[:, 0:8, 0:8].reshape(4, 64)
    assert (dct.image_bits(x)[:, :64] == (block > np.median(block, axis=1)[:, None])).all()
    with pytest.raises(ValueError):
        codes.image_code(bytes(100))
    with pytest.raises(ValueError):
        codes.image_code(bytes(1024), 288)


def test_video():
    assert sequences.winners(np.zeros(380), 64) == bytes(8)
    frames = [[f * 380 + i for i in range(380)] for f in range(10)]
    assert codes.video_code(frames) == codes.video_code(frames + frames[:3])
    for bad, bits in ((379, 64), (380, 0), (380, 12), (380, 264)):
        with pytest.raises(ValueError):
            sequences.winners(np.zeros(bad), bits)
    for bad in ([], [[]], [[1] * 380, [1] * 379]):
        with pytest.raises(ValueError):
            codes.video_code(bad)


def test_parts():
    assert [p.tolist() for p in sequences.parts(np.arange(1, 6), 3)] == [[1, 2], [3, 4], [5]]
    assert [len(p) for p in sequences.parts(np.arange(2), 4)] == [1, 1, 0, 0]


def test_mixed():
    two = ["EUA6GIKXN42IQV3S", "EIAUKMOUIOYZCKA5"]
    r = codes.mixed_code(two)
    assert r["parts"] == two and codec.decoded(r["iscc"])[:4] == (2, 4, 0, 1)
    raw = [codec.read_base32(c) for c in two]
    assert codec.decoded(r["iscc"])[4] == simhash.simhash([x[:1] + x[2:9] for x in raw])
    for bad in (two[:1], [two[0], "AAAYPXW445FTYNJ3"], [two[0], codec.unit(2, 0, 0, 32, bytes(4))]):
        with pytest.raises(ValueError):
            codes.mixed_code(bad)


def test_codec():
    assert [codec.header(*h).hex() for h in ((0, 0, 0, 1), (0, 0, 0, 8), (3, 0, 0, 1), (4, 0, 0, 1))] == ["0001", "000800", "3001", "4001"]
    for n, size in ((0, 4), (1, 4), (7, 4), (8, 8), (71, 8), (72, 12), (583, 12), (584, 16), (4679, 16)):
        bits = codec.varnibble(n)
        assert len(bits) == size and codec.read_varnibble(bits + "0101", 0) == (n, size)
    with pytest.raises(ValueError):
        codec.varnibble(4680)
    assert codec.decoded("GAA2XTPPAERUKZ4J") == (3, 0, 0, 1, bytes.fromhex("abcdef0123456789"))
    assert codec.decoded("ISCC:gaa2-xtpp-aeru-kz4j")[4].hex() == "abcdef0123456789"
    assert codec.component(3, 0, 0, 64, bytes.fromhex("abcdef0123456789")) == "GAA2XTPPAERUKZ4J"
    assert [codec.base64_url(b) for b in (b"", b"Hello", b"\xff\xfe")] == ["", "SGVsbG8", "__4"]
    for args in ((0, 0, 0, 64, bytes(7)), (5, 0, 0, 64, bytes(8)), (8, 0, 0, 64, bytes(8)), (0, 8, 0, 64, bytes(8)), (0, 0, 1, 64, bytes(8)), (0, 0, 0, 40, bytes(8))):
        with pytest.raises(ValueError):
            codec.component(*args)
    for bad in ("GAA2XTPPAERUKZ4", "GAA2XTPPAERUKZ41", "GAA2", "iscc:GAA2XTPPAERUKZ4J"):
        with pytest.raises(ValueError):
            codec.decoded(bad)


def test_composites():
    whole = codec.composed(UNITS)
    assert whole == "ISCC:KACYPXW445FTYNJ3CYSXHAFJMA2HUWULUNRFE3BLHRSCXYH2M5AEGQY"
    parts = codec.decomposed(whole)
    assert [codec.decoded(p)[0] for p in parts] == [0, 2, 3, 4]
    assert [codec.decoded(p)[4] for p in parts] == [codec.decoded(u)[4][:8] for u in UNITS]
    assert codec.composed(UNITS[::-1]) == whole and codec.decomposed("ISCC:" + UNITS[0]) == UNITS[:1]
    wide = codec.composed([UNITS[2], UNITS[3]], wide=True)
    assert codec.decoded(wide)[1] == 7 and [codec.decoded(p)[3] for p in codec.decomposed(wide)] == [3, 3]
    narrow = codec.composed([UNITS[2], UNITS[3]])
    assert codec.decoded(narrow)[1] == 5 and codec.composed([UNITS[0], UNITS[2], UNITS[3]], wide=True)[5:7] == "KY"
    raw = codec.read_base32(whole[5:])
    joined = codec.base32(codec.read_base32(UNITS[0]) + codec.read_base32(UNITS[1]))
    assert codec.decomposed(joined) == UNITS[:2]
    for bad in (UNITS[:1], UNITS[:3], [UNITS[0], UNITS[3]], [*UNITS[:2], "EEAQAAAAAAAAAAAA", *UNITS[2:]], ["AAAA", *UNITS]):
        with pytest.raises(ValueError):
            codec.composed(bad)
    for n in (3, 9, 17, len(raw) - 1):
        with pytest.raises(ValueError):
            codec.decomposed(codec.base32(raw[:n]))


def test_sum():
    for data in (b"", b"abc" * 5000):
        r = codes.sum_code(data, units=True)
        assert r["iscc"] == codec.composed([codes.data_code(data)["iscc"], codes.instance_code(data)["iscc"]]) and r["filesize"] == len(data)
        assert codes.sum_code(data)["units"] is None


@pytest.mark.parametrize(
    ("x", "wanted"),
    [(0, "0"), (-0.0, "0"), (1.0, "1"), (1e20, "100000000000000000000"), (1e21, "1e+21"), (1.5e-7, "1.5e-7"), (0.000001, "0.000001"), (123.456, "123.456"), (-2.5, "-2.5"), (5e-324, "5e-324"), (1.7976931348623157e308, "1.7976931348623157e+308"), (9007199254740993, "9007199254740992"), (10**25, "1e+25"), (333333333.33333329, "333333333.3333333")],
)
def test_canonical_numbers(x, wanted):
    assert jcs.number(x) == wanted


def test_canonical_json():
    assert jcs.canonical('{"b":1,"a":2}') == b'{"a":2,"b":1}'
    assert jcs.canonical('{"\\ud83d\\ude00":1,"\\ufb33":2,"a":[true,null,"\\u0001\\n\\u20ac"]}').decode() == '{"a":[true,null,"\\u0001\\n€"],"😀":1,"דּ":2}'
    assert jcs.json_url('{"@context":1}').startswith("data:application/ld+json;base64,")
