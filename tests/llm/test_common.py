import os

from prismark.llm import common


def test_clean(spark):
    path = common.shared_dir(spark)
    df = common.written(spark.range(3), f"{path}/a")
    assert df.count() == 3 and os.path.isdir(path.removeprefix("file://"))
    made = list(common.MADE)
    common.MADE[:] = [path]
    common.clean(spark)
    assert not os.path.exists(path.removeprefix("file://")) and not common.MADE
    common.MADE[:] = [m for m in made if m != path]


def test_fold_and_slices(spark):
    import zlib

    import pyarrow as pa

    got = {r.id: r.f for r in spark.range(50).withColumn("f", common.fold("id", 7)).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 7 for i in range(50)}
    assert [b.num_rows for b in common.slices(iter([pa.record_batch([pa.array(range(5))], ["a"])]), 2)] == [2, 2, 1]


def test_slices_are_bounded_by_bytes():
    import pyarrow as pa

    texts = ["x" * n for n in (10, 5000, 3, 900, 900, 900, 1, 1)]
    got = list(common.slices(iter([pa.record_batch([pa.array(texts)], ["t"])]), 100, 2000))
    assert [t for b in got for t in b.column(0).to_pylist()] == texts
    assert all(b.num_rows == 1 or b.nbytes <= 2000 for b in got) and len(got) < len(texts)


def test_words_are_kept_in_two_generations():
    made = []
    kept = common.Kept(lambda w: made.append(w) or w.upper(), 10)
    for k in range(200):
        assert kept["often"] == "OFTEN" and kept[f"once{k}"] == f"ONCE{k}"
        assert len(kept) + len(kept.older) <= 10
    assert made.count("often") == 1
    long = "w" * (common.LONGEST_WORD + 1)
    assert kept[long] == kept[long] and made.count(long) == 2 and long not in kept


def test_word_hashes():
    """Equal words alike wherever they stand, other words apart, long ones whole; counts as by split."""
    import numpy as np

    from prismark.llm.words import word_hashes

    texts = [b"", b" \n\t ", b"a", b"The the THE tHe", b"abcdefgh abcdefghi abcdefghj", b"x" * 5000 + b" " + b"x" * 4999 + b" " + b"x" * 5000, "é É straße".encode(), b"a\x1cb\x00 c\x85d", b"a"]
    h, n = word_hashes(texts)
    split = [t.lower().split() for t in texts]
    assert n.tolist() == [len(s) for s in split]
    of = {}
    for w, x in zip([w for s in split for w in s], h.tolist(), strict=True):
        assert of.setdefault(w, x) == x
    assert len(set(of.values())) == len(of)
    one, _ = word_hashes([b"word"])
    assert one[0] == word_hashes([b"some other word", b"z"])[0][2]
    assert [len(x) for x in word_hashes([])] == [0, 0] and isinstance(h, np.ndarray)
