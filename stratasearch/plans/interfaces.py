"""What a vector store and a sparse index offer, and both over tables that live in the session.

The engine itself keeps its tables on shared storage (``store.py``). These classes are for callers that hold an index of their own, or put
another service behind the same methods. All results are DataFrames; nothing is collected but the numbers that checks need.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bm25, dense
from ..operators.lookups import also_in, only_in


class VectorStore(ABC):
    """Vectors by namespace and id."""

    @abstractmethod
    def add(self, namespace: str, rows: DataFrame) -> None:
        """Insert rows (chunk_id, vector); ids that are there already, and vectors of another length, are refused."""

    @abstractmethod
    def delete(self, namespace: str, ids: Sequence[str]) -> None: ...

    @abstractmethod
    def clear(self, namespace: str) -> None: ...

    @abstractmethod
    def query(self, namespace: str, vector: Sequence[float], k: int, ids: DataFrame | None = None) -> DataFrame:
        """(chunk_id, namespace, score, rank) of the k best in a namespace, of the given ids if there are any."""

    @abstractmethod
    def query_global(self, vector: Sequence[float], k: int, without: Sequence[str] | None = None) -> DataFrame:
        """The same over all namespaces but some."""


class SparseIndex(ABC):
    """A BM25 index of chunks."""

    @abstractmethod
    def add(self, chunks: DataFrame) -> None:
        """Add chunks (chunk_id, repo_id, file_path, content); those with known ids replace them."""

    @abstractmethod
    def remove(self, ids: Sequence[str]) -> None: ...

    @abstractmethod
    def query(self, text: str, k: int, ids: DataFrame | None = None) -> DataFrame:
        """(query_id, chunk_id, repo_id, score, rank) of the k best."""

    @abstractmethod
    def doc_count(self) -> int: ...


class TableVectorStore(VectorStore):
    """Vectors in a DataFrame (chunk_id, namespace, vector); each change makes a new one."""

    def __init__(self, spark: SparkSession, dim: int, metric: str = "ip"):
        self.dim, self.metric = dim, metric
        self.rows = spark.createDataFrame([], "chunk_id string, namespace string, vector array<float>")

    def add(self, namespace: str, rows: DataFrame) -> None:
        if not rows.where(F.coalesce(F.size("vector"), F.lit(-1)) != self.dim).isEmpty():
            raise ValueError(f"vectors of {self.dim} components are wanted")
        if not also_in(rows, self.rows.where(F.col("namespace") == namespace)).isEmpty():
            raise ValueError(f"ids that {namespace} holds already")
        new = rows.select("chunk_id", F.lit(namespace).alias("namespace"), F.col("vector").cast("array<float>").alias("vector"))
        self.rows = self.rows.unionByName(dense.prepared(new, self.metric))

    def delete(self, namespace: str, ids: Sequence[str]) -> None:
        self.rows = self.rows.where(~((F.col("namespace") == namespace) & F.col("chunk_id").isin(list(ids))))

    def clear(self, namespace: str) -> None:
        self.rows = dense.in_namespaces(self.rows, without=[namespace])

    def query(self, namespace: str, vector: Sequence[float], k: int, ids: DataFrame | None = None) -> DataFrame:
        inside = dense.in_namespaces(self.rows, only=[namespace])
        return dense.nearest(inside if ids is None else also_in(inside, ids), vector, k, self.metric)

    def query_global(self, vector: Sequence[float], k: int, without: Sequence[str] | None = None) -> DataFrame:
        return dense.nearest(dense.in_namespaces(self.rows, without=without), vector, k, self.metric)


class TableSparseIndex(SparseIndex):
    """Postings and statistics in DataFrames; additions and removals are set operations on them."""

    def __init__(self, chunks: DataFrame):
        tokens = bm25.tokenized(chunks)
        self.postings, self.stats = bm25.postings(tokens), bm25.doc_stats(tokens)

    def add(self, chunks: DataFrame) -> None:
        tokens = bm25.tokenized(chunks)
        self.postings = only_in(self.postings, tokens).unionByName(bm25.postings(tokens))
        self.stats = bm25.with_chunks(self.stats, bm25.doc_stats(tokens))

    def remove(self, ids: Sequence[str]) -> None:
        self.postings = self.postings.where(~F.col("chunk_id").isin(list(ids)))
        self.stats = self.stats.where(~F.col("chunk_id").isin(list(ids)))

    def query(self, text: str, k: int, ids: DataFrame | None = None) -> DataFrame:
        asked = self.stats.sparkSession.createDataFrame([(0, text)], "query_id int, query string")
        return bm25.top(bm25.scores(asked, self.postings, self.stats, ids), k)

    def doc_count(self) -> int:
        return self.stats.count()
