import random

import pytest

from prismark.llm.common import shared_dir
from prismark.llm.components import components


@pytest.mark.parametrize("kind", ["path", "star", "random", "cycle", "none"])
def test_against_union_find(spark, kind):
    rng = random.Random(4)
    edges = {"path": [(i, i + 1) for i in range(60)], "star": [(99, i) for i in range(60)], "cycle": [(i, (i + 1) % 31) for i in range(31)], "none": [], "random": [(rng.randrange(200), rng.randrange(200)) for _ in range(120)]}[kind]
    edges = edges + edges[:5] + [(7_000, 7_000), (None, 3), (4, None)] * bool(edges)
    up: dict = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = sorted((top(a), top(b)))
            up[y] = x
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.id: r.component_id for r in components(df, shared_dir(spark)).collect()}
    assert got == {x: top(x) for x in up}
