"""Connected components against a plain union."""

import random

import pytest

from newsloom.operators.graph import components


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(400) - 200, rng.randrange(400) - 200) for _ in range(180)]
    edges += [(1000 + k, 1001 + k) for k in range(60)]  # a path
    edges += [(2000, 2001 + k) for k in range(90)] + [(5, 5)]  # a star; a loop
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            lo, hi = sorted((root(a), root(b)))
            parent[hi] = lo
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
