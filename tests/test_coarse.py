"""Neighbours from cells are those of comparing everything, and clustered vectors are mostly left out."""

import numpy as np
import pytest

from stratasearch.operators import dense
from stratasearch.operators.coarse import CoarseIndex, fit_centroids

SCHEMA = "chunk_id string, namespace string, vector array<double>"


def table(spark, x, extra=()):
    rows = [(f"c{k:04}", f"n{k % 3}", [float(v) for v in row]) for k, row in enumerate(x)]
    return spark.createDataFrame([*rows, *extra], SCHEMA)


def ask(spark, x):
    return spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "query_id long, vector array<double>")


def rows(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], r["namespace"], round(r["score"], 7)) for r in df.collect())


def clusters(n, dim=12, centres=30, width=0.03, seed=4):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((centres, dim))
    return c[rng.integers(0, centres, n)] + width * rng.standard_normal((n, dim))


@pytest.mark.parametrize("metric", ["ip", "cosine"])
@pytest.mark.parametrize("width", [0.03, 3.0])
def test_as_comparing_everything(spark, tmp_path, metric, width):
    x = clusters(900, width=width)
    extra = [("z1", "n", None), ("z2", "n", []), ("z3", "n", [1.0, 2.0]), ("z4", "n", [0.0] * 12), ("c0001b", "n", [float(v) for v in x[1]])]
    stored = table(spark, x, extra)
    queries = ask(spark, np.concatenate([x[:25] + 0.01, -x[:3]])).unionByName(spark.createDataFrame([(90, None), (91, [1.0, 1.0]), (92, [])], "query_id long, vector array<double>"))
    index = CoarseIndex.build(stored, str(tmp_path / "index"), cells=24, metric=metric)
    kept = stored if metric == "ip" else stored.where("chunk_id <> 'z4'")
    assert rows(index.nearest(queries, 7)) == rows(dense.batch_nearest(kept, queries, 7, metric))
    seen = {r["query_id"]: r["rows_read"] / r["rows"] for r in index.visits(queries, 7).collect()}
    if width < 1:
        assert np.mean([seen[k] for k in range(25)]) < 0.35
    assert max(seen.values()) <= 1


def test_cells_that_nobody_visits_are_not_read(spark, tmp_path):
    import shutil

    x = clusters(900, width=0.01)
    index = CoarseIndex.build(table(spark, x), str(tmp_path / "index"), cells=30)
    queries = ask(spark, x[:2] * 10)
    first, second = index._rounds(queries, 3)
    visited = {r["cell"] for part in (first, second) for r in part.select("cell").distinct().collect()}
    want = rows(index.nearest(queries, 3))
    gone = [f for f in (tmp_path / "index" / "vectors").glob("cell=*") if int(f.name.split("=")[1]) not in visited]
    assert gone
    for folder in gone:
        shutil.rmtree(folder)
    assert rows(CoarseIndex(spark, str(tmp_path / "index")).nearest(queries, 3)) == want


def test_small_and_empty(spark, tmp_path):
    index = CoarseIndex.build(table(spark, np.ones((2, 3))), str(tmp_path / "two"))
    assert [r[2] for r in rows(index.nearest(ask(spark, np.ones((1, 3))), 5))] == ["c0000", "c0001"]
    none = CoarseIndex.build(table(spark, np.ones((1, 3))).limit(0), str(tmp_path / "none"))
    assert none.nearest(ask(spark, np.ones((1, 3))), 5).collect() == []
    with pytest.raises(ValueError):
        CoarseIndex.build(table(spark, np.ones((1, 3))), str(tmp_path / "l2"), metric="l2")
    assert len(fit_centroids(np.ones((10, 2)), 4)) == 1
