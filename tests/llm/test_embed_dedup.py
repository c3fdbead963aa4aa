import numpy as np
import pytest

from prismark.llm import embed_dedup


def brute(rows, t=0.93):
    ok = [(i, np.array(v, dtype=np.float64), lab) for i, v, lab in rows if v and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, up = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, (i, x, p) in enumerate(ok):
        for j, y, q in ok[a + 1 :]:
            if p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= t:
                links[i] += 1
                links[j] += 1
                u, v = sorted((top(i), top(j)))
                up[v] = u
    return {i: (links[i], top(i)) for i in links}


def table(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for n, spread in ((60, 0.02), (40, 0.05), (80, 1.0)):
        centre = rng.normal(size=12)
        rows += [(centre + spread * rng.normal(size=12)).astype(np.float32).tolist() for _ in range(n)]
    rows += [rows[0]] * 25 + [[x * 3 for x in rows[1]]] + [None, [], [0.0] * 12, [None] * 12, [float("nan")] * 12, [float("inf")] + [1.0] * 11, [1.0] * 5, [1.0] * 5, [-0.0] * 12, [1e-30] * 12]
    order = rng.permutation(len(rows))
    return [(int(k) * 3 + 1, rows[at], None if k % 17 == 0 else int(k % 2)) for k, at in enumerate(order)]


@pytest.mark.parametrize("block", [7, 1024])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    rows = table(block)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_odd_tables(spark):
    schema = "vec_id long, embedding array<double>, label string, data string, id long"
    df = spark.createDataFrame([(None, [1.0, 0.0], "a", "x", 9), (1, [1.0, 0.0], "a", "x", 9), (1, [1.0, 0.01], "a", "x", 9), (2, [0.0, 1.0], "a", None, None)], schema)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(df).collect()), key=str)
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True), (None, 0, None, True)]
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_bound_loses_nothing():
    """Every near pair is sent to both cells, for centroids of any quality."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 8))
    y = x + 0.2 * rng.normal(size=x.shape) * np.linalg.norm(x, axis=1)[:, None] / np.sqrt(8)
    x, y = (v / np.linalg.norm(v, axis=1)[:, None] for v in (x, y))
    c = embed_dedup.centroids(x[:50], 12)
    home_x, reach_x = embed_dedup.may_reach(x, c, 0.93)
    home_y, _ = embed_dedup.may_reach(y, c, 0.93)
    near = (x * y).sum(axis=1) >= 0.93
    assert near.sum() > 100 and reach_x[np.arange(400), home_y][near].all() and reach_x[np.arange(400), home_x].all()
    assert reach_x.mean() < 0.9


def test_recall_of_few_probes(spark):
    rows = table(3)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    exact = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(df).collect()}
    some = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(df, probes=1).collect()}
    assert all(some[i] <= n for i, n in exact.items()) and sum(some.values()) >= 0.9 * sum(exact.values())


def test_very_small_and_very_large_vectors(spark):
    """Squares of these under- or overflow; their cosines don't."""
    base = [0.6, -0.3, 0.2]
    rows = [(k, [x * s for x in base], "a") for k, s in enumerate((1.0, 1e-200, 1e200, 5e-324 / 0.2, 3.0, 1e-160))] + [(9, [x * 1e-200 for x in (-0.6, 0.3, 0.2)], "a"), (10, [1e308, 1e308, 1e308], "a"), (11, [1e-300] * 3, "a"), (12, [0.0] * 3, "a")]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert {k: got[k] for k in (0, 1, 2, 4, 5)} == dict.fromkeys((0, 1, 2, 4, 5), (5 if got[3][0] else 4, 0))
    assert got[9] == (0, 9) and got[10] == got[11] == (1, 10) and got[12] == (0, 12)
