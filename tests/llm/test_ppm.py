import math
import zlib
from collections import Counter, defaultdict

import numpy as np
from conftest import ODD

from prismark.llm import ppm

K = ppm.ORDER


def brute(texts, held):
    """Tries of plain dictionaries, escapes and exclusions symbol by symbol."""
    low = lambda t: (t or "").encode().lower()
    seen = [defaultdict(Counter) for _ in range(K + 1)]
    words, ends = Counter(), 0
    for t, h in zip(texts, held, strict=True):
        if h:
            continue
        s = [ppm.START] * K + list(low(t)) + [ppm.END]
        for j in range(K, len(s)):
            for o in range(K + 1):
                seen[o][tuple(s[j - o : j])][s[j]] += 1
        words.update(low(t).split())
        ends += 1
    n, v = sum(words.values()) + ends, len(words) + bool(ends)
    out = []
    for t in texts:
        s, total = [ppm.START] * K + list(low(t)) + [ppm.END], 0.0
        for j in range(K, len(s)):
            gone: set = set()
            for o in range(K, -1, -1):
                here = {c: k for c, k in seen[o].get(tuple(s[j - o : j]), {}).items() if c not in gone}
                size = sum(here.values())
                if s[j] in here:
                    total += math.log10((2 * here[s[j]] - 1) / (2 * size))
                    break
                if here:
                    total += math.log10(len(here) / (2 * size))
                gone |= set(here)
            else:
                total -= math.log10(ppm.SYMBOLS - len(gone))
        w = low(t).split()
        base = sum(math.log10((words[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        out.append((len(w) + 1, sum(words[x] > 0 for x in w) + bool(ends), n, base, total))
    return out


def test_against_brute_force(spark, odd, monkeypatch):
    monkeypatch.setattr(ppm, "BLOCK_BYTES", 20_000)
    texts = [*ODD, ODD[4], "a row without an id"]
    ids = [*range(len(ODD)), 4, None]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i in ids]
    assert any(held) and not all(held)
    got = sorted(ppm.scored(odd, ppm.held_out_by()).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    want = [w for _, w in sorted(zip(ids, brute(texts, held), strict=True), key=lambda x: (x[0] is None, x[0]))]
    assert len(got) == len(want)
    for r, w in zip(got, want, strict=True):
        assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3]
        assert math.isclose(r.base_score, w[3], rel_tol=1e-9) and math.isclose(r.score, w[4], rel_tol=1e-9)


def test_a_context_is_a_distribution(spark):
    """Over all symbols after a context the probabilities sum to 1, whatever was excluded on the way."""
    rng = np.random.default_rng(0)
    text = bytes(rng.integers(97, 101, 400, dtype=np.uint8))
    learned = ppm.strings(text, np.array([len(text)]))
    keys, n = np.unique(learned, return_counts=True)
    for context in (int(learned[50]) >> 9, int(learned[0]) >> 9, 0x1234567):
        asked = np.array([context << 9 | s for s in range(ppm.SYMBOLS)], dtype=np.int64)
        counts = dict.fromkeys(asked.tolist(), 0) | dict(zip(keys.tolist(), n.tolist(), strict=True))
        df = spark.createDataFrame([(int(k), int(c)) for k, c in counts.items()], "key long, n long")
        from prismark.llm.common import shared_dir

        values = {r.key: r.value for r in ppm.probabilities(df, shared_dir(spark)).collect()}
        assert math.isclose(sum(10 ** values[int(k)] for k in asked), 1, rel_tol=1e-9)


def test_nothing_learned_and_empty(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "c")], "doc_id long, text string")
    from pyspark.sql import functions as F

    got = {r.doc_id: r for r in ppm.scored(df, F.lit(True)).collect()}
    assert math.isclose(got[1].score, -3 * math.log10(257)) and got[1].n_known == 0 and got[1].train_tokens == 0
    assert ppm.scored(df.limit(0), F.lit(False)).count() == 0


def test_values_table():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(-(2**62), 2**62, 5000))
    values = rng.random(len(keys))
    some = rng.integers(0, len(keys), 20_000)
    assert (ppm.Values(keys, values).of(keys[some]) == values[some]).all()


def test_zipped_floats():
    for a in (np.zeros(0), np.random.default_rng(0).normal(size=1000), np.array([-0.0, np.inf, 1e-320])):
        assert ppm.unzipped_floats(ppm.zipped_floats(a)).tobytes() == a.tobytes()


def test_fans():
    assert ppm.fans(1) == [ppm.LEAST_PARTS] and ppm.fans(128) == [128] and ppm.fans(129) == [128, 16]
    assert ppm.fans(6000) == [128, 47] and ppm.fans(12_000_000) == [128, 128, 128, 16]
    keys = np.unique(np.random.default_rng(1).integers(-(2**62), 2**62, 5000))
    places = [tuple(int(ppm.digit_of(keys[k : k + 1], [3, 2, 4], level)[0]) for level in range(3)) for k in range(0, 5000, 50)]
    assert len(set(places)) > 20


def test_several_levels(spark, monkeypatch):
    """Many blocks of documents, merged two at a time over four levels; hot and null ids are rows like others."""
    monkeypatch.setattr(ppm, "FAN", 2)
    monkeypatch.setattr(ppm, "LEAST_PARTS", 2)
    monkeypatch.setattr(ppm, "BLOCK_BYTES", 64)
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["ab", "Abra", "cad", "abr", "x"], rng.integers(0, 30))) for _ in range(45)]
    ids = [7 if k < 15 else None if k < 20 else k for k in range(45)]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i in ids]
    assert any(held) and not all(held)
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(9)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 8), round(r.score, 8)) for r in ppm.scored(df, ppm.held_out_by()).collect())
    assert got == sorted((-1 if i is None else i, *w[:3], round(w[3], 8), round(w[4], 8)) for i, w in zip(ids, brute(texts, held), strict=True))
