"""Vectors as short codes: the nearest entry of a codebook for each of a few parts of a vector.

Components become integers and a vector is cut into consecutive parts. Each part position has a codebook of up to 256
entries, which starts as the parts of the smallest ids and is moved to the floored mean of its parts in each round.

The nearest entry is found in a ball tree over the entries. A node has an integer centre and a radius that is rounded
up, so ``distance to the centre - radius``, rounded down, is never above the distance to any entry inside. A node is
visited unless that bound is above the best distance so far; an equal bound is visited too, since an entry at the same
distance with a lower index wins. Entries themselves are compared by squared distances in whole numbers.

A round is one pass without a shuffle of vectors: tasks send counts and sums for each entry, which Spark adds up; the
driver sees at most ``parts * entries`` rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, removed, written

#: Entries of a leaf.
LEAF = 16
#: A label with more than this share of all rows is joined by a broadcast; there can be no more than its inverse.
HOT_SHARE = 1e-3


def _down(x: np.ndarray) -> np.ndarray:
    """Below any true value whose rounded result, two steps deep, is ``x``."""
    return np.nextafter(np.nextafter(x, -np.inf), -np.inf)


def _up(x: float) -> float:
    return math.nextafter(math.nextafter(x, math.inf), math.inf)


def largest_component(width: int) -> int:
    """Components of at most this size keep every squared distance of ``width`` of them, and what it is summed from, below 2^53."""
    return math.isqrt(2**51 // max(width, 1))


class BallTree:
    """The entries of one part position; squared distances of integers below 2^53 are exact in double precision."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.float64)
        self.norms = (self.entries**2).sum(axis=1)
        self.centres: list[np.ndarray] = []
        self.radii: list[float] = []
        self.inside: list[np.ndarray | None] = []
        self.halves: list[tuple[int, int]] = []
        if len(entries):
            self._grow(np.arange(len(entries)))
            self.centre_rows = np.stack(self.centres)
            self.centre_norms = (self.centre_rows**2).sum(axis=1)

    def _grow(self, own: np.ndarray) -> int:
        node = len(self.centres)
        points = self.entries[own]
        centre = np.rint(points.mean(axis=0))
        from_centre = ((points - centre) ** 2).sum(axis=1)
        self.centres.append(centre)
        self.radii.append(_up(math.sqrt(from_centre.max())))
        self.inside.append(own if len(own) <= LEAF else None)
        self.halves.append((0, 0))
        if len(own) > LEAF:
            far = points[from_centre.argmax()]
            other = points[((points - far) ** 2).sum(axis=1).argmax()]
            order = np.argsort(points @ (other - far), kind="stable")
            cut = len(own) // 2
            self.halves[node] = (self._grow(np.sort(own[order[:cut]])), self._grow(np.sort(own[order[cut:]])))
        return node

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of the nearest entry of each point, the lower one of equals, and the squared distance."""
        points = points.astype(np.float64)
        size = (points**2).sum(axis=1)
        to_centre = size[:, None] - 2 * (points @ self.centre_rows.T) + self.centre_norms
        bound = np.maximum(_down(_down(np.sqrt(to_centre)) - np.array(self.radii)), 0)
        bound = np.maximum(_down(bound * bound), 0)
        best = np.full(len(points), np.inf)
        index = np.full(len(points), len(self.entries))

        def visit(node: int, rows: np.ndarray) -> None:
            rows = rows[bound[rows, node] <= best[rows]]
            if not len(rows):
                return
            if self.inside[node] is None:
                left, right = self.halves[node]
                nearer = to_centre[rows, left] <= to_centre[rows, right]
                for first, second, some in ((left, right, rows[nearer]), (right, left, rows[~nearer])):
                    visit(first, some)
                    visit(second, some)
                return
            own = self.inside[node]
            distance = size[rows, None] - 2 * (points[rows] @ self.entries[own].T) + self.norms[own]
            least = distance.argmin(axis=1)
            distance, entry = distance[np.arange(len(rows)), least], own[least]
            better = (distance < best[rows]) | ((distance == best[rows]) & (entry < index[rows]))
            best[rows[better]] = distance[better]
            index[rows[better]] = entry[better]

        visit(0, np.arange(len(points)))
        return index, best.astype(np.int64)


def usable(vector: Column) -> Column:
    """The vector is there, has components, and all of them are finite numbers."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~odd, F.lit(False))


def whole_numbers(vector: Column, scale: int, most: int) -> Column:
    """floor(scale * x) of each component, by double precision; beyond ``most`` it stays at ``most``."""
    return F.transform(vector, lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(most)), F.lit(-most)).cast("int"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class Codebooks:
    """Codebooks of all part positions: integers of shape (parts, entries, width of a part)."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries

    @property
    def sha256(self) -> str:
        """Digest of all components in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def trees(self) -> list[BallTree]:
        return [BallTree(book) for book in self.entries]

    def moved(self, sums: list) -> Codebooks:
        """Entries at the floored mean of their parts; rows of (part, entry, count, sums by position). Unused entries stay."""
        entries = self.entries.copy()
        for part, entry, count, *total in sums:
            entries[part, entry] = [x // count for x in total]
        return Codebooks(entries)


def _sums(rows: DataFrame, books: Codebooks) -> list:
    """Count and componentwise sums of the parts nearest to each entry: at most parts * entries rows."""
    parts, entries, width = books.entries.shape
    trees = books.trees()
    totals = [f"s{i}" for i in range(width)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((parts, entries), dtype=np.int64)
        total = np.zeros((parts, entries, width), dtype=np.int64)
        for batch in batches:
            vectors = _matrix(batch.column(0), parts * width).astype(np.int64)
            for part, tree in enumerate(trees):
                own = vectors[:, part * width : (part + 1) * width]
                nearest, _ = tree.nearest(own)
                order = np.argsort(nearest, kind="stable")
                used, first = np.unique(nearest[order], return_index=True)
                if len(used):
                    total[part, used] += np.add.reduceat(own[order], first, axis=0)
                    count[part] += np.bincount(nearest, minlength=entries)
        part, entry = np.nonzero(count)
        columns = [part.astype(np.int64), entry.astype(np.int64), count[part, entry], *total[part, entry].T]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in columns], names=["part", "entry", "n", *totals])

    schema = T.StructType([T.StructField(name, T.LongType()) for name in ["part", "entry", "n", *totals]])
    found = rows.select("ints").mapInArrow(task, schema)
    return found.groupBy("part", "entry").agg(*[F.sum(name) for name in ["n", *totals]]).collect()


def fit(rows: DataFrame, order: list[Column], parts: int, entries: int, rounds: int) -> Codebooks:
    """Codebooks for ``rows`` with integer vectors ``ints``, started from the first ``entries`` rows in ``order``."""
    start = np.array([r.ints for r in rows.orderBy(*order).limit(entries).select("ints").collect()], dtype=np.int64)
    books = Codebooks(start.reshape(len(start), parts, -1).transpose(1, 0, 2))
    for _ in range(rounds):
        books = books.moved(_sums(rows, books))
    return books


def encode(rows: DataFrame, books: Codebooks, columns: list[str], code: str = "code", error: str = "error") -> DataFrame:
    """``columns`` of ``rows``, with ``code`` (a byte for each part) and ``error`` (sum of squared distances)."""
    parts, _, width = books.entries.shape
    trees = books.trees()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column(batch.num_columns - 1), parts * width)
            found = [tree.nearest(vectors[:, k * width : (k + 1) * width]) for k, tree in enumerate(trees)]
            codes = np.stack([index for index, _ in found], axis=1).astype(np.uint8)
            flat = pa.Array.from_buffers(pa.binary(parts), len(codes), [None, pa.py_buffer(np.ascontiguousarray(codes))])
            rest = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*rest, flat.cast(pa.binary()), pa.array(sum(d for _, d in found))], names=[*columns, code, error])

    own = rows.select(*columns, "ints")
    schema = T.StructType([*own.schema.fields[:-1], T.StructField(code, T.BinaryType()), T.StructField(error, T.LongType())])
    return own.mapInArrow(task, schema)


def _label_sums(rows: DataFrame, most_broadcast: int) -> DataFrame:
    """``rows`` (vec_id, label, code, error) with label_error, the sum of error over the rows of the label (nulls are one label)."""
    sums = materialize(
        rows.groupBy("label").agg(F.try_sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")).withColumnRenamed("label", "of")
    )
    same = F.col("label").eqNullSafe(F.col("of"))
    if sums.count() <= most_broadcast:
        return rows.join(F.broadcast(sums), same).drop("of", "n")
    total = sums.agg(F.sum("n")).first()[0]
    hot = F.broadcast(sums.where(F.col("n") > total * HOT_SHARE))
    cold = sums.where(F.col("n") <= total * HOT_SHARE)
    often = rows.join(hot, same)
    rest = rows.join(hot, same, "left_anti").join(cold, same)
    return often.unionByName(rest).drop("of", "n")


def compress_vectors(
    vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, most_labels_broadcast: int = 100_000
) -> DataFrame:
    """One row per usable vector: vec_id, code (two hex digits a part), error, label_error, codebooks_sha256.

    Reads vec_id, embedding and label; other columns are ignored. Vectors that are null, empty, or hold null or
    non-finite components are left out, and so are those that haven't the most common length (the shortest of equally
    common ones) or whose length ``parts`` doesn't divide. ``entries`` is 256 at most. Repeated rows come back as often as they
    come; of equal ids the one with the smaller integers starts a codebook first, null ids come last. With fewer vectors than
    ``entries`` there are as many entries as vectors; an empty table gives no rows. Integers beyond ``largest_component`` (11,863,283 for
    parts of 16) stay at it, which keeps all distances exact. A label's sum beyond a 64-bit integer is null.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte a part: entries must be from 1 to 256")
    spark = vectors.sparkSession
    kept = vectors.where(usable(F.col("embedding")) & (F.size("embedding") % parts == 0)).select("vec_id", "label", "embedding")
    common = kept.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if common is None:
        return spark.createDataFrame([], T.StructType([vectors.schema["vec_id"], *(T.StructField(n, t) for n, t in (
            ("code", T.StringType()), ("error", T.LongType()), ("label_error", T.LongType()), ("codebooks_sha256", T.StringType())
        ))]))
    ints = whole_numbers(F.col("embedding"), scale, largest_component(common["size"] // parts)).alias("ints")
    rows, folder = written(kept.where(F.size("embedding") == common["size"]).select("vec_id", "label", ints), "vectors")
    books = fit(rows, [F.asc_nulls_last("vec_id"), F.asc("ints")], parts, entries, rounds)
    coded = materialize(encode(rows, books, ["vec_id", "label"]))
    removed(spark, folder)
    return _label_sums(coded, most_labels_broadcast).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256")
    )
