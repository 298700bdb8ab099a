"""Exact nearest neighbours that read only part of the vectors.

The vectors are laid out in cells around centroids, with each cell's radius: the greatest distance of a vector to its centroid, rounded up.
By the triangle inequality no vector of a cell scores above ``q . c + |q| * radius``. A query first visits its few best cells, which gives
a k-th best score; then it visits every other cell whose bound reaches that score, so the result is that of comparing everything. Cells that
no query visits aren't read: the table has a folder for each cell, and the visits prune the folders.

How much is left out depends on the vectors: cells of well separated vectors are left out, cells of vectors without structure hardly ever. ``visits`` says how many rows each query met.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import norm, normalize
from ..sources.tables import shared_folder
from .bm25 import SCORE_PLACES
from .dense import STORED_BLOCK, _passes

#: Vectors for each centroid in the sample that the centroids are fitted on, in the driver; and rounds of fitting.
SAMPLE_PER_CELL, ROUNDS = 32, 8
#: The cell of vectors that haven't the length of the centroids.
OTHER = -1
CELLS = "cell int, n long, radius double, centroid array<double>, metric string"
#: What bounds are raised by, for rounded sums and scores.
SLACK = 1e-7


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Up to ``cells`` centroids of a sample: far rows first, then means."""
    chosen = [0]
    nearest = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(cells, len(sample)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    centroids = sample[chosen]
    for _ in range(rounds):
        cell = _distances(sample, centroids).argmin(axis=1)
        for k in np.unique(cell):
            centroids[k] = sample[cell == k].mean(axis=0)
    return centroids


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, up to rounding."""
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ centroids.T) + (centroids * centroids).sum(axis=1)[None, :]


def _bounds(vectors: pd.Series, centroids: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the queries that have the centroids' length, and the greatest score that each cell may hold for each."""
    fits = np.flatnonzero(vectors.map(len).to_numpy() == centroids.shape[1]) if len(vectors) and len(radii) else np.zeros(0, dtype=int)
    if not len(fits):
        return fits, np.zeros((0, len(radii)))
    q = np.stack(vectors.iloc[fits].to_list()).astype(np.float64)
    size = np.sqrt((q * q).sum(axis=1))[:, None]
    reach = size * (np.sqrt((centroids**2).sum(axis=1)) + radii)[None, :]
    return fits, q @ centroids.T + size * radii[None, :] + SLACK * (1 + reach)


class CoarseIndex:
    """An index below ``path``: ``vectors`` with a folder for each cell, and ``cells`` with centroids, radii and numbers of rows.

    ``metric``: ip, or cosine, for which vectors are brought to length one when they are stored, and those without a length are left out.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        about = spark.read.schema(CELLS).parquet(f"{path}/cells").orderBy("cell").collect()  # as many rows as cells
        self.metric = about[0]["metric"] if about else "ip"
        self.rows = {r["cell"]: r["n"] for r in about}
        known = [r for r in about if r["cell"] != OTHER]
        self.cells = np.array([r["cell"] for r in known], dtype=np.int64)
        self.centroids = np.array([r["centroid"] for r in known], dtype=np.float64) if known else np.zeros((0, 1))
        self.radii = np.array([r["radius"] for r in known], dtype=np.float64)

    @staticmethod
    def build(vectors: DataFrame, path: str, cells: int = 64, metric: str = "ip") -> CoarseIndex:
        """Write an index of ``vectors`` (chunk_id, namespace, vector). The centroids are fitted on ``cells * SAMPLE_PER_CELL`` rows chosen by a hash;
        every vector is stored. Null and empty vectors are left out. Centroids have the length of the sample's first row."""
        if metric not in ("ip", "cosine"):
            raise ValueError(f"no bound for {metric}")
        spark = vectors.sparkSession
        usable = vectors.where(F.size("vector") > 0).select("chunk_id", "namespace", F.col("vector").cast("array<double>").alias("vector"))
        if metric == "cosine":
            usable = usable.where(norm("vector") > 1e-9).withColumn("vector", normalize("vector"))
        some = [r["vector"] for r in usable.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(cells * SAMPLE_PER_CELL).select("vector").collect()]
        sample = np.array([v for v in some if len(v) == len(some[0])], dtype=np.float64) if some else np.zeros((0, 1))
        centroids = fit_centroids(sample, cells) if some else sample
        kind = T.StructType([*usable.schema.fields, T.StructField("away", T.DoubleType()), T.StructField("cell", T.IntegerType())])

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                cell, away = np.full(len(batch), OTHER), np.zeros(len(batch))
                fits = np.flatnonzero(batch["vector"].map(len).to_numpy() == centroids.shape[1]) if len(batch) else []
                if len(fits):
                    x = np.stack(batch["vector"].iloc[fits].to_list()).astype(np.float64)
                    best = _distances(x, centroids).argmin(axis=1)
                    cell[fits] = best
                    away[fits] = np.sqrt(((x - centroids[best]) ** 2).sum(axis=1))
                yield batch.assign(away=away, cell=cell.astype(np.int32))

        placed = usable.mapInPandas(place, kind).hint("rebalance", "cell")
        placed.write.partitionBy("cell").parquet(f"{path}/vectors")
        found = spark.read.schema(kind).parquet(f"{path}/vectors").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("away")).collect()
        rows = [(r["cell"], r["n"], float(np.nextafter(r["away"] * (1 + 1e-12), np.inf)), centroids[r["cell"]].tolist() if r["cell"] != OTHER else [], metric) for r in found]
        spark.createDataFrame(rows, CELLS).coalesce(1).write.parquet(f"{path}/cells")
        return CoarseIndex(spark, path)

    def _asked(self, queries: DataFrame, first: int | None) -> DataFrame:
        """(query_id, vector, cell): the ``first`` best cells of each query, or those behind them whose bound reaches ``least``."""
        kind = T.StructType([queries.schema["query_id"], T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("cell", T.IntegerType())])
        probes, cells, centroids, radii = self.probes, self.cells, self.centroids, self.radii

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                fits, bounds = _bounds(batch["vector"], centroids, radii)
                order = np.argsort(-bounds, axis=1, kind="stable")
                rank = np.argsort(order, axis=1, kind="stable")
                if first is None:
                    q, c = np.nonzero((rank >= probes) & (bounds >= batch["least"].to_numpy()[fits][:, None]))
                    others = np.zeros(0, dtype=int)
                else:
                    q, c = np.nonzero(rank < first)
                    others = np.setdiff1d(np.arange(len(batch)), fits)
                at = np.concatenate([fits[q], others]).astype(int)
                cell = np.concatenate([cells[c], np.full(len(others), OTHER)])
                yield pd.DataFrame({"query_id": batch["query_id"].to_numpy()[at], "vector": batch["vector"].to_numpy()[at], "cell": cell.astype(np.int32)})

        columns = ["query_id", "vector", *(["least"] if first is None else [])]
        return queries.select(*columns).mapInPandas(run, kind)

    def _met(self, asked: DataFrame, k: int) -> DataFrame:
        """(query_id, chunk_id, namespace, score): in each block of a cell the ``k`` best of each query that visits it."""
        stored = self.spark.read.parquet(f"{self.path}/vectors")
        wanted = F.broadcast(asked.select("cell").distinct().where(F.col("cell") >= OTHER))  # as many rows as cells
        kinds = {f.name: f.dataType.simpleString() for f in stored.schema.fields}
        some = stored.join(wanted, "cell", "left_semi").select("cell", "chunk_id", "namespace", "vector")
        packed = some.mapInPandas(_packed, f"cell int, chunk_id array<{kinds['chunk_id']}>, namespace array<{kinds['namespace']}>, dim int, matrix binary")
        groups = asked.groupBy("cell", F.pmod(F.xxhash64("query_id"), F.lit(16)).alias("part")).agg(
            F.collect_list("query_id").alias("query_id"), F.collect_list("vector").alias("asked")
        )
        schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, chunk_id {kinds['chunk_id']}, namespace {kinds['namespace']}, score double"
        return packed.join(groups.drop("part"), "cell").mapInPandas(_best_of(k), schema)

    probes = 2

    def visits(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, rows_read, rows): how many rows each query met, of all."""
        first, second = self._rounds(queries, k)
        sizes = F.create_map(*[F.lit(x) for c, n in sorted(self.rows.items()) for x in (c, n)])
        every = first.select("query_id", "cell").unionByName(second.select("query_id", "cell"))
        return every.groupBy("query_id").agg(F.sum(F.coalesce(sizes[F.col("cell")], F.lit(0))).alias("rows_read"), F.lit(sum(self.rows.values())).alias("rows"))

    def _prepared(self, queries: DataFrame) -> DataFrame:
        asked = queries.where(F.size("vector") > 0).select("query_id", F.col("vector").cast("array<double>").alias("vector"))
        if self.metric == "cosine":
            asked = asked.where(norm("vector") > 1e-9).withColumn("vector", normalize("vector"))
        return asked

    def _rounds(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """The visits of the first round, and those of the second."""
        asked = self._prepared(queries)
        first = self._asked(asked, self.probes)
        least = _top(self._met(first, k), k).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        behind = asked.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
        return first, self._asked(behind, None)

    def nearest(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, chunk_id, namespace, score, rank): the k best vectors of each query (query_id, vector), as from comparing all of them.

        Null and empty queries, and vectors of another length than the query's, have no neighbours; of equal scores the lesser chunk_id comes first.
        """
        if not self.rows:
            return queries.limit(0).selectExpr("query_id", "cast(null as string) chunk_id", "cast(null as string) namespace", "cast(null as double) score", "cast(null as int) rank")
        shared_folder(self.spark)
        parts = []
        for part, _ in _passes(self._prepared(queries), k):
            best = _top(self._met(self._asked(part, self.probes), k), k).checkpoint()  # at most k rows a query of a bounded part
            least = best.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
            behind = part.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
            parts += [best.drop("rank"), self._met(self._asked(behind, None), k)]
        return _top(reduce(DataFrame.unionByName, parts), k)


def _top(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (cell, chunk_id, namespace, vector) as blocks of one cell and length."""
    for batch in batches:
        rows = []
        for (cell, dim), part in batch.groupby([batch["cell"], batch["vector"].map(len)]):
            for at in range(0, len(part), STORED_BLOCK):
                some = part.iloc[at : at + STORED_BLOCK]
                matrix = np.stack(some["vector"].to_list()).astype(np.float64)
                rows.append((cell, some["chunk_id"].tolist(), some["namespace"].tolist(), dim, matrix.tobytes()))
        yield pd.DataFrame(rows, columns=["cell", "chunk_id", "namespace", "dim", "matrix"])


def _best_of(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for ids, names, dim, matrix, queries, asked in zip(batch["chunk_id"], batch["namespace"], batch["dim"], batch["matrix"], batch["query_id"], batch["asked"]):
                own = [n for n, q in enumerate(asked) if len(q) == dim]
                if not own:
                    continue
                stored = np.frombuffer(matrix, np.float64).reshape(-1, dim)
                score = np.round(stored @ np.stack([asked[n] for n in own]).astype(np.float64).T, SCORE_PLACES)
                n = min(k, len(stored))
                least = -np.partition(-score, n - 1, axis=0)[n - 1]
                i, q = np.nonzero(score >= least)
                found = pd.DataFrame({"query_id": np.asarray(queries, dtype=object)[np.array(own)[q]], "chunk_id": np.asarray(ids, dtype=object)[i], "namespace": np.asarray(names, dtype=object)[i], "score": score[i, q]})
                out.append(found.sort_values(["query_id", "score", "chunk_id"], ascending=[True, False, True]).groupby("query_id").head(k))
            yield pd.concat(out) if out else pd.DataFrame({"query_id": [], "chunk_id": [], "namespace": [], "score": []})

    return run
