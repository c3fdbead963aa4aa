import random
import re

import numpy as np
import pytest
from conftest import ODD

from prismark.llm import minhash


def brute(rows, words, part, whole):
    """Components over plain sets of shingles: {id: (n_shingles, component)} for unique ids."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            both = len(sets[i] & sets[j])
            if both and whole * both >= part * (len(sets[i]) + len(sets[j]) - both):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


def family(rng, base, n, most):
    """Copies of a text with up to ``most`` words changed."""
    out = []
    for _ in range(n):
        w = base[:]
        for k in rng.sample(range(len(w)), rng.randrange(most)):
            w[k] = f"new{rng.randrange(10**9)}"
        out.append(" ".join(w))
    return out


def documents(seed, n=120):
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 3000}"
    texts = [" ".join(word() for _ in range(rng.randrange(1, 160))) for _ in range(n)]
    texts += family(rng, [f"b{k}" for k in range(150)], 70, 9) + family(rng, [f"c{k}" for k in range(60)], 40, 12)
    shared = " ".join(f"s{k}" for k in range(60))
    texts += [shared + " " + " ".join(word() for _ in range(rng.randrange(5, 40))) for _ in range(40)]
    texts += [texts[0]] * 30 + [texts[1].upper()] * 3 + [texts[2].replace(" ", "\n\t ")]
    rng.shuffle(texts)
    return [(i * 7 + 3, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("words", "part", "seed"), [(3, 85, 1), (5, 80, 2)])
def test_against_brute_force(spark, monkeypatch, words, part, seed):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rows = documents(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, words, part, 100).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in brute(rows, words, part, 100).items()}


def test_odd_rows(spark, odd):
    got = minhash.near_duplicates(odd, 3, 85, 100).collect()
    assert len(got) == len(ODD) + 2
    want = brute(enumerate(ODD), 3, 85, 100)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept and r.n_shingles == 3
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.component_id == r.doc_id)
    assert minhash.near_duplicates(odd.limit(0)).count() == 0
    kept = minhash.deduplicated(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=lambda i: (i is None, i)) == [*(i for i in range(len(ODD)) if i != 5), None]


def test_every_pair_within_the_distance_shares_a_key(spark):
    """The pigeonhole guarantee itself, at the greatest distance that is promised."""
    rng = np.random.default_rng(1)
    for m in (5, 7, 9):
        a = rng.integers(0, 1 << 16, (200, minhash.SYMBOLS), dtype=np.uint16)
        b = a.copy()
        for row in b:
            at = rng.choice(minhash.SYMBOLS, 2 * m - 1, replace=False)
            row[at] ^= 1
        rows = [(k, bytearray(x.astype("<u2").tobytes())) for k, x in enumerate(np.concatenate([a, b]))]
        keys = minhash.keyed(spark.createDataFrame(rows, "id long, signature binary"), m)
        per = keys.groupBy("key").agg({"id": "collect_set"}).collect()
        together = {(min(x), max(x)) for r in per if len(x := r[1]) > 1}
        assert {(k, k + 200) for k in range(200)} <= together


def test_chunks_for():
    assert minhash.chunks_for(0.85) == 7 and minhash.chunks_for(0.99) <= 3
    with pytest.raises(ValueError):
        minhash.chunks_for(0.05)


def test_spanning():
    linked = np.zeros((5, 5), dtype=bool)
    for x, y in ((0, 1), (1, 2), (0, 2), (3, 4)):
        linked[x, y] = linked[y, x] = True
    links = minhash.spanning(linked, np.arange(5))
    assert len(links) == 3 and len(minhash.spanning(linked, np.array([0, 0, 0, 3, 4]))) == 1


def test_clashing_and_null_ids_are_compared(spark):
    """Decided per row: texts that share an id are no copies, rows without an id are compared."""
    one, two, three, four = (" ".join(f"{c}{k}" for k in range(60)) for c in "abcd")
    near = one + " more"
    rows = [(1, one), (1, two), (1, near), (2, near), (None, two), (None, three), (None, three), (None, three + " more"), (0, four), (None, four), (1, ""), (1, ""), (3, ""), (None, ""), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    first = None
    for n in (1, 4):
        got = [tuple(r) for r in minhash.deduplicated(df.repartition(n)).collect()]
        assert sorted((i is None, i or 0, t.removesuffix(" more")) for i, t in got) == sorted([(False, 0, four), (False, 1, one), (False, 1, two), (False, 1, ""), (False, 3, ""), (True, 0, three), (True, 0, ""), (True, 0, "")])
        first = sorted(got, key=str) if n == 1 else first
        assert sorted(got, key=str) == first
