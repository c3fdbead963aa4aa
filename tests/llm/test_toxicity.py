import random

from conftest import ODD

from prismark.llm import toxicity
from prismark.llm.common import fold

CLEAN = [f"{a}{b}" for a in ("mo", "ta", "ri", "ke", "lu") for b in ("na", "so", "vi", "der", "pel", "gam", "tir", "bon")]


def corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(CLEAN) for _ in range(rng.randrange(20, 200))]
        bad, rude = rng.random() < 0.15, rng.random() < 0.2
        if rude:
            words += [f"dratt{rng.choice(['ed', 'ing', 'y', 's', 'ish'])}"]
        if bad:
            words += rng.choices(["vilek", "gromph", "skarn"], k=2)
        rng.shuffle(words)
        rows.append((i, " ".join(words).title(), int(rude), int(bad or rude and "drattish" in words)))
    return rows


def test_chain_on_held_out_rows():
    train, test = corpus(1500, 1), corpus(500, 2)
    chain = toxicity.chain_of([toxicity.words(t) for _, t, _, _ in train], {"rude": [r for *_, r, _ in train], "bad": [b for *_, b in train]})
    assert [len(k.earlier) for k in chain.links] == [0, 1]
    for k, c in enumerate(("rude", "bad")):
        right = sum((chain.probabilities(r[1])[k] >= chain.links[k].threshold) == bool(r[2 + k]) for r in test)
        assert right >= (0.99 if c == "rude" else 0.97) * len(test)


def test_earlier_probability_is_used():
    """The second category is the first one's negation, and has no word of its own but the first one's."""
    rng = random.Random(5)
    rows = [{rng.choice(CLEAN) for _ in range(9)} | ({"flag"} if i % 2 else set()) for i in range(400)]
    chain = toxicity.chain_of(rows, {"a": [i % 2 for i in range(400)], "b": [1 - i % 2 for i in range(400)]})
    assert chain.links[1].earlier[0] < 0
    assert chain.probabilities("flag")[1] < 0.2 < 0.8 < chain.probabilities("mona")[1]


def test_degenerate_labels():
    rows = [{"a"}, {"b"}, {"c"}]
    chain = toxicity.chain_of(rows, {"none": [None] * 3, "all": [1, 1, 1], "no": [0, 0, None]})
    p = chain.probabilities("a b c")
    assert p[0] < 0.01 and p[1] > 0.99 and p[2] < 0.01
    assert toxicity.chain_of([], {"x": []}).probabilities("") == [toxicity.sigmoid(-40.0)]


def test_frames(spark, odd):
    rows = corpus(600, 3)
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, r, b) for i, _, r, b in rows] + [(7, None, None), (8, None, 1), (None, 1, 1), (10**9, 1, 1)], "doc_id long, rude int, bad int")
    chain = toxicity.learned(docs, labels, ["rude", "bad"], sample_rows=400)
    got = toxicity.predicted(docs, chain).join(labels.dropna().dropDuplicates(["doc_id"]), "doc_id").collect()
    assert sum(r.is_bad == bool(r.bad) for r in got) >= 0.95 * len(got)
    out = toxicity.predicted(odd, chain).collect()
    assert len(out) == len(ODD) + 2 and out[0].__fields__ == ["doc_id", "text", "lang", "data", "score", "id", "p_rude", "is_rude", "p_bad", "is_bad"]
    assert len({(r.p_rude, r.p_bad) for r in out if r.text in (None, "", " \n\t")}) == 1
    assert toxicity.predicted(odd.limit(0), chain).count() == 0
    assert toxicity.learned(docs, labels.limit(0), ["rude", "bad"]).probabilities("x")[0] < 0.01


def test_synthetic_documents(spark):
    """Trained without the held-out fold: toxic documents are found, others left alone."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.of_documents(docs, labels, hold_out=True)
    got = toxicity.predicted(docs, chain).where("lang = 'en'").join(labels, "doc_id").where(fold("doc_id", 5) == 1).collect()
    assert len(got) > 30 and sum(r.is_toxic == bool(r.toxic) for r in got) >= 0.95 * len(got)


def slow_fit(rows, y, before, weight, keep, l1, l2, steps=6000):
    """Logistic regression by small steps over dictionaries, one row after another."""
    import math

    w, d, b, n = dict.fromkeys(keep, 0.0), [0.0] * len(before[0]), 0.0, len(rows)
    for k in range(steps):
        gw, gd, gb = dict.fromkeys(keep, 0.0), [0.0] * len(d), 0.0
        for r, t, p, own in zip(rows, y, before, weight, strict=True):
            s = b + sum(w[x] for x in r if x in w) + sum(a * v for a, v in zip(d, p, strict=True))
            e = (1 / (1 + math.exp(-s)) - t) * own / n
            for x in r:
                if x in gw:
                    gw[x] += e
            gd, gb = [a + e * v for a, v in zip(gd, p, strict=True)], gb + e
        rate = 0.5
        for x in w:
            v = w[x] - rate * (gw[x] + l2 * w[x])
            w[x] = math.copysign(max(abs(v) - rate * l1, 0), v)
        d, b = [a - rate * (g + l2 * a) for a, g in zip(d, gd, strict=True)], b - rate * gb
    return w, d, b


def test_fit_against_small_steps():
    """The accelerated fit finds the same minimum as plain steps, with and without the penalty on size."""
    import numpy as np

    rng = random.Random(4)
    names = ["a", "b", "c", "d"]
    rows = [[w for w in names if rng.random() < 0.5] for _ in range(40)]
    y = [int(("a" in r) + rng.random() > 0.9) for r in rows]
    before, weight = [[rng.random()] for _ in rows], [rng.choice([0.5, 1.0, 2.0]) for _ in rows]
    mean = sum(weight) / len(weight)
    for l1, l2 in ((0.02, 0.0), (0.0, 0.02)):
        x = toxicity.Rows.of([np.array([names.index(w) for w in r], dtype=np.int64) for r in rows], np.array(before))
        w, d, b = toxicity.fitted(x, np.array(y, float), 4, l1, l2, 4000, np.array(weight))
        want, want_d, want_b = slow_fit(rows, y, before, [v / mean for v in weight], names, l1, l2, 3000)
        assert max(abs(w[k] - want[n]) for k, n in enumerate(names)) < 0.02 and abs(d[0] - want_d[0]) < 0.05 and abs(b - want_b) < 0.05


def test_chain_against_brute_force(monkeypatch):
    """Out-of-fold probabilities, the models' inputs and the chain's predictions, each told again by plain loops."""
    import math

    import numpy as np

    rows = [toxicity.words(t) for _, t, _, _ in corpus(120, 9)]
    labels = {"rude": [r for *_, r, _ in corpus(120, 9)], "bad": [None if k % 13 == 0 else b for k, (*_, b) in enumerate(corpus(120, 9))]}
    fits, fit = [], toxicity.fitted

    def watched(x, y, features, l1, l2, rounds, weight, only=None):
        out = fit(x, y, features, l1, l2, rounds, weight, only)
        if l2:
            fits.append((len(y), x.dense.copy(), y.copy(), out))
        return out

    monkeypatch.setattr(toxicity, "fitted", watched)
    chain = toxicity.chain_of(rows, labels, min_z=2.0)

    def said(link, present, before):
        s = link.base + sum(a * p for a, p in zip(link.earlier, before, strict=True)) + sum(w for name, w in link.weights.items() if name in present)
        return 1 / (1 + math.exp(-max(-40, min(40, s))))

    # Three folds and the whole for each of two categories; a fold's model does not see it, nor rows without a label.
    assert [n for n, *_ in fits] == [80, 80, 80, 120] + [sum(1 for k in range(120) if k % 3 != f and k % 13) for f in range(3)] + [sum(1 for k in range(120) if k % 13)]
    known = sorted(w for w in set().union(*rows) if sum(w in r for r in rows) >= 4)
    out_of_fold = [0.0] * 120
    for f, (_, _, _, (w, _, b)) in enumerate(fits[:3]):
        weights = dict(zip(known, w.tolist(), strict=True))
        for k in range(f, 120, 3):
            out_of_fold[k] = 1 / (1 + math.exp(-(b + sum(weights.get(x, 0.0) for x in rows[k]))))
    inside = [k for k in range(120) if k % 13]
    assert np.allclose(fits[-1][1][:, 0], [out_of_fold[k] for k in inside], atol=1e-9)
    assert fits[-1][2].tolist() == [labels["bad"][k] for k in inside]
    for _, t, _, _ in corpus(30, 10):
        p = chain.probabilities(t)
        first = said(chain.links[0], toxicity.words(t), [])
        assert np.allclose(p, [first, said(chain.links[1], toxicity.words(t), [first])], atol=1e-12)


def test_hot_ids(spark):
    """An id labelled very often, and one that very many documents share: the sample stays bounded, the rest is learned."""
    rows = corpus(300, 6)
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows] + [(5000, f"{t} {i}") for i, t, _, _ in corpus(2000, 7)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, r, b) for i, _, r, b in rows] + [(5000, 0, 0)] * 3000, "doc_id long, rude int, bad int")
    seen = []
    fit, toxicity.chain_of = toxicity.chain_of, lambda r, *a, **o: seen.append(len(r)) or fit(r, *a, **o)
    try:
        chain = toxicity.learned(docs, labels, ["rude", "bad"], sample_rows=600)
    finally:
        toxicity.chain_of = fit
    assert 200 < seen[0] < 1300
    assert chain.probabilities("mona gromph vilek skarn")[1] > chain.probabilities("mona")[1]
    assert len(toxicity.bounded({f"w{k}" for k in range(50)}, 10)) == 10 and toxicity.bounded({"b", "a"}) == ["a", "b"]
