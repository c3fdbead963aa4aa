import io

import pytest

from prismark import api


def test_results_and_selftest(tmp_path):
    assert api.conformance_selftest()
    r = api.gen_meta_code_v0("Hello", meta={"some": "object"})
    assert r.iscc == r["iscc"] == "ISCC:AAAWKLHFXN63LHL2" and "description" not in r
    with pytest.raises(AttributeError):
        r.description  # noqa: B018
    data = bytes(range(256)) * 50
    (tmp_path / "f").write_bytes(data)
    s = api.gen_sum_code_v0(tmp_path / "f", add_units=True)
    assert s.units == [api.gen_data_code_v0(data).iscc, api.gen_instance_code_v0(data).iscc] and s.iscc == api.gen_iscc_code_v0(s.units).iscc
    assert "units" not in api.gen_sum_code_v0(str(tmp_path / "f"))
    with pytest.raises(ValueError, match="Cannot open file"):
        api.gen_sum_code_v0(tmp_path / "none")


@pytest.mark.parametrize("wrap", [bytes, bytearray, memoryview, io.BytesIO])
def test_kinds_of_bytes(wrap):
    data = b"some bytes" * 999
    assert api.gen_data_code_v0(wrap(data)) == api.gen_data_code_v0(data)
    assert api.gen_instance_code_v0(wrap(data)) == api.gen_instance_code_v0(data)
    d, i = api.DataHasher(wrap(data)), api.InstanceHasher()
    i.update(wrap(data))
    assert d.finalize() == api.gen_data_code_v0(data) and i.finalize() == api.gen_instance_code_v0(data)
    assert api.gen_image_code_v0(wrap(bytes(1024))).iscc == "ISCC:EEAQAAAAAAAAAAAA"
    assert api.gen_image_code_v0([0] * 1024).iscc == "ISCC:EEAQAAAAAAAAAAAA"


def test_primitives_and_enums():
    assert api.iscc_decode("GAA2XTPPAERUKZ4J") == (api.MT.DATA, api.ST.NONE, api.VS.V0, 1, bytes.fromhex("abcdef0123456789"))
    assert api.encode_component(3, 0, 0, 64, bytes.fromhex("abcdef0123456789")) == "GAA2XTPPAERUKZ4J"
    assert api.ST.TEXT == api.ST.NONE == 0 and api.core_opts.text_ngram_size == 13
    assert api.alg_minhash_256([]) == b"\xff" * 32 and api.alg_cdc_chunks(b"") == [b""]
    assert api.soft_hash_video_v0([[0] * 380], 64) == bytes(8)
