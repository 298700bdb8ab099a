import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratasearch.llm.vector_codes import BallTree, compress_vectors, largest_component

SCHEMA = "vec_id long, embedding array<float>, label int, code string, of string, n long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "mine", "x", 7) for i, v, label in rows], SCHEMA)


def directly(rows, parts=4, entries=256, rounds=4):
    """The contract word by word, in Python's own integers."""
    good = [(i, v, label) for i, v, label in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    ints = [[int(np.floor(1024 * np.float64(np.float32(x)))) for x in v] for _, v, _ in good]
    order = sorted(range(len(good)), key=lambda k: (good[k][0] is None, good[k][0] or 0, ints[k]))
    width = len(ints[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for v in ints] for p in range(parts)]
    books = [[cut[p][k] for k in order[:entries]] for p in range(parts)]

    def nearest(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for v in cut[p]:
                groups.setdefault(nearest(p, v)[1], []).append(v)
            for k, own in groups.items():
                books[p][k] = [sum(x) // len(own) for x in zip(*own)]
    found = [[nearest(p, cut[p][k]) for p in range(parts)] for k in range(len(good))]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for (_, _, label), e in zip(good, errors):
        by_label[label] = by_label.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(
        ((i, "".join(f"{k:02x}" for _, k in f), e, by_label[label], digest) for (i, _, label), f, e in zip(good, found, errors)), key=str
    )


def answer(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 200), st.integers(1, 6), st.integers(1, 2000), st.integers(0, 2**32 - 1))
def test_tree_equals_brute_force_with_ties(n, width, spread, seed):
    rng = np.random.default_rng(seed)
    entries = rng.integers(-spread, spread + 1, (n, width)) // rng.choice([1, spread])
    points = np.concatenate([rng.integers(-spread, spread + 1, (60, width)), entries[rng.integers(0, n, 20)]])
    index, distance = BallTree(entries).nearest(points)
    all_pairs = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (index == all_pairs.argmin(axis=1)).all()
    assert (distance == all_pairs.min(axis=1)).all()


def test_tree_is_exact_for_the_largest_components():
    most = largest_component(3)
    entries = np.array([[most, most, most], [most, most, most - 1], [-most, -most, -most]] * 20)
    points = np.array([[-most, -most, -most], [most, most, most - 1], [0, 0, 0], [most, most, most]])
    index, distance = BallTree(entries).nearest(points)
    wide = points.astype(object)
    every = [[sum((a - b) ** 2 for a, b in zip(p, e)) for e in entries.astype(object)] for p in wide]
    assert index.tolist() == [row.index(min(row)) for row in every]
    assert distance.tolist() == [min(row) for row in every]


def test_tree_leaves_out_far_nodes(monkeypatch):
    """In low dimensions most entries are never compared."""
    rng = np.random.default_rng(5)
    tree = BallTree(rng.integers(-10_000, 10_000, (256, 2)))
    compared = []

    class Counting(np.ndarray):
        def __getitem__(self, key):
            compared.append(len(key))
            return np.asarray(super().__getitem__(key))

    tree.entries = tree.entries.view(Counting)
    for point in rng.integers(-10_000, 10_000, (20, 2)):
        tree.nearest(point[None])
    assert sum(compared) < 0.35 * 256 * 20


@pytest.mark.parametrize("n,most_labels", [(330, 100_000), (330, 0), (7, 100_000)])
def test_codes_equal_the_direct_version(spark, n, most_labels):
    random.seed(n)
    middles = [[random.gauss(0, 0.2) for _ in range(8)] for _ in range(5)]
    rows = [(3 * k, [m + random.gauss(0, 0.05) for m in middles[k % 5]], random.choice([None, 1, 1, 1, 2])) for k in range(n)]
    rows += [(rows[2][0], rows[4][1], 1), (rows[2][0], rows[2][1], 1), (None, rows[1][1], 2), (None, rows[1][1], None)]
    rows += [(1, None, 1), (4, [0.1] * 7 + [None], 1), (5, [float("nan")] + [0.1] * 7, 2), (7, [0.1] * 7 + [float("-inf")], 2), (8, [], 1)]
    got = compress_vectors(frame(spark, rows).repartition(5), most_labels_broadcast=most_labels)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert answer(got) == directly(rows)


def test_other_lengths_and_huge_components(spark):
    rows = [(k, [0.001 * k] * 4, 0) for k in range(5)]
    odd = [(10, [0.5] * 8, 0), (11, [0.5] * 3, 0), (12, [0.5], 1)]
    assert answer(compress_vectors(frame(spark, rows + odd))) == directly(rows)
    far = compress_vectors(frame(spark, rows + [(20, [3e38, -3e38, 1.0, 0.0], 0)])).collect()
    assert len(far) == 6 and all(r.error == 0 for r in far)


def test_hot_label_and_tables_without_rows(spark):
    rows = [(k, [random.random() for _ in range(4)], 1 if k % 3 else k) for k in range(600)]
    both = [answer(compress_vectors(frame(spark, rows), rounds=1, most_labels_broadcast=m)) for m in (0, 1000)]
    assert both[0] == both[1] == directly(rows, rounds=1)
    assert compress_vectors(frame(spark, [])).collect() == []
    assert compress_vectors(frame(spark, [(1, None, 1)])).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(ValueError):
        compress_vectors(frame(spark, rows), entries=257)
