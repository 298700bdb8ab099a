"""Connected components of a graph given as edges, without collecting any of it.

Rounds of a large star (every neighbour above a node is tied to the least node it knows) and a small star (every
node and its lesser neighbours are tied to the least of them) turn any graph into stars around the least node of each
component. Each round is a handful of grouped minima and joins over at most as many edges as there were. A graph of no more than SMALL_GRAPH
edges, which are counted first, is settled in one task of a few megabytes instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


#: Edges, of 16 bytes, that one task settles.
SMALL_GRAPH = 200_000


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges (u, v) of a small graph become (id, component)."""
    edges = [np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)]) for batch in batches if batch.num_rows]
    if edges:
        ids, place = np.unique(np.concatenate(edges, axis=1), return_inverse=True)
        member, least = star_edges(ids, *place.reshape(2, -1))
        roots = np.unique(least)
        columns = np.concatenate([member, roots]), np.concatenate([least, roots])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "component"])


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("least"))


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) of every id with an edge to another one; the component is its least id.

    ``edges``: two long columns ``a`` and ``b``. Nulls, loops and repeated edges don't matter.
    """
    current = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    if current.count() <= SMALL_GRAPH:
        return current.coalesce(1).mapInArrow(_settled, "id long, component long")
    before = None
    for _ in range(most_rounds):
        state = current.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == before or state["n"] == 0:
            break
        before = state
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both).select("u", F.least("u", "least").alias("least"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        small = large.join(_least(large), "u").select(F.explode(F.array(F.struct("u", F.col("least").alias("v")), F.struct(F.col("v").alias("u"), F.col("least").alias("v")))).alias("e"))
        current = materialize(small.select("e.*").where("u <> v").distinct())
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("v").alias("id")).distinct()
    return current.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        roots.select("id", F.col("id").alias("component"))
    )


class Forest:
    """Union-find over the positions 0..n-1 of rows that one task holds."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return int(x)

    def union(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True

    def labels(self) -> np.ndarray:
        parent = self.parent
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        self.parent = parent
        return parent


def star_edges(ids: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as the edges between positions ``left`` and ``right`` of ``ids``, as one star for each."""
    if len(left) == 0:
        return ids[:0], ids[:0]
    used, place = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = place[: len(left)], place[len(left) :]
    label = np.arange(len(used))
    while True:  # least labels over edges, with shortcuts
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    member = np.flatnonzero(label != np.arange(len(used)))
    return ids[used[member]], ids[used[label[member]]]
