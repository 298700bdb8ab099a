"""Connected components against union-find, on chains, stars and random graphs."""

import random

import numpy as np
import pytest

from stratasearch.llm import components
from stratasearch.llm.components import connected_components, star_edges


def direct(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    return {x: find(x) for x in list(parent)}


RANDOM = random.Random(9)
GRAPHS = [
    [],
    [(1, 1), (None, 2)],
    [(k, k + 1) for k in range(60)],
    [(0, k) for k in range(1, 40)] + [(100, k) for k in range(101, 120)],
    [(RANDOM.randrange(200), RANDOM.randrange(200)) for _ in range(140)] * 2,
    [(2**60 + k, -(2**61) + k % 3) for k in range(9)],
]


@pytest.mark.parametrize("small", [0, 200_000])
@pytest.mark.parametrize("edges", GRAPHS)
def test_components(spark, monkeypatch, edges, small):
    monkeypatch.setattr(components, "SMALL_GRAPH", small)
    frame = spark.createDataFrame(edges, "a long, b long")
    assert {r["id"]: r["component"] for r in connected_components(frame).collect()} == direct(edges)


def test_star_edges():
    rng = np.random.default_rng(4)
    ids = rng.permutation(1000)[:300]
    left, right = rng.integers(0, 300, 250), rng.integers(0, 300, 250)
    a, b = star_edges(ids, left, right)
    edges = list(zip(ids[left].tolist(), ids[right].tolist()))
    groups = {}
    for x, root in direct(list(zip(a.tolist(), b.tolist()))).items():
        groups.setdefault(root, set()).add(x)
    want = {}
    for x, root in direct(edges).items():
        want.setdefault(root, set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
