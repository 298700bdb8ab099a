"""Dense retrieval: encoders and exact nearest neighbours.

A stated set of query vectors is compared with all stored vectors in blocks: stored rows and queries are packed into matrices, every two
of which are multiplied where they meet, and a task keeps the k best of each query; a window over these few rows gives the final ranks.
That is one scan of the vectors for as many queries as may be broadcast and held, whatever their scopes; more queries take further scans, in the same plan. Vectors don't pass
through the driver. Filters on ids, and on the namespace where it is the same for all queries, reach the scan; ``layout`` prunes by the queries' scopes.
"""

from __future__ import annotations

import hashlib
import re
import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.plain import token_lists
from ..functions.vectors import norm, normalize, similarity
from ..sources.tables import kept, shared_folder
from .bm25 import SCORE_PLACES

#: Query vectors and stored vectors of one matrix.
QUERY_BLOCK, STORED_BLOCK = 512, 2048
#: Tokens whose places a worker remembers before it starts afresh.
REMEMBERED_TOKENS = 1_000_000
#: Queries whose exact neighbours set the bucket length of the approximate search.
CALIBRATION_QUERIES = 32
#: Stored rows that tell how much a bucket length leaves.
CALIBRATION_ROWS = 2000
#: The share of all rows from which on hashed candidates cost more than the exact search.
MOST_LEFT = 0.5
#: Queries that are broadcast at once, and rows that a task holds for them.
MOST_ASKED_BYTES, MOST_BEST_ROWS = 64 << 20, 500_000


class PermanentError(RuntimeError):
    """A failure that trying again can't mend: a wrong key, an unknown model, vectors of another length."""


def fitted(text: str, count: Callable[[str], int], budget: int) -> str:
    """The longest prefix of a text with at most ``budget`` tokens, found by halving; at worst nothing is left.

    Counts of prefixes are taken to grow with their length.
    """
    if count(text) <= budget:
        return text
    low, high = 0, len(text)  # a prefix of ``low`` fits, one of ``high`` doesn't
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if count(text[:middle]) <= budget else (low, middle)
    return text[:low]


class Encoder(ABC):
    """Turns texts into vectors. Instances are shipped to the executors, so they must be picklable."""

    @property
    @abstractmethod
    def name(self) -> str: ...

    @property
    @abstractmethod
    def dim(self) -> int: ...

    @abstractmethod
    def encode(self, texts: Sequence[str]) -> list[np.ndarray | None]:
        """A vector for each text; None where a text could not be encoded."""


class HashingEncoder(Encoder):
    """Signed feature hashing of tokens: no model, the same everywhere.

    A token's first eight hex digits of md5 are a number h: its place is h mod dim and its sign comes from (h div dim) mod 2.
    """

    def __init__(self, dim: int = 64):
        self._dim = dim

    @property
    def name(self) -> str:
        return f"hashing-{self._dim}"

    @property
    def dim(self) -> int:
        return self._dim

    def place(self, token: str) -> tuple[int, int]:
        h = int(hashlib.md5(token.encode()).hexdigest()[:8], 16)
        return h % self._dim, 1 - 2 * (h // self._dim % 2)

    def encode(self, texts: Sequence[str]) -> list[np.ndarray | None]:
        from ..functions.plain import tokenize as plain

        return list(self.encode_tokens(pa.array([plain(t) for t in texts], pa.list_(pa.string()))))

    def encode_tokens(self, tokens: pa.ListArray) -> np.ndarray:
        """A row for each list of tokens; each distinct token of the batch is hashed once."""
        words = tokens.flatten().dictionary_encode()
        known = _places.setdefault(self._dim, {})
        if len(known) > REMEMBERED_TOKENS:
            known.clear()
        places = np.array([known.get(w) or known.setdefault(w, self.place(w)) for w in words.dictionary.to_pylist()], dtype=np.int64).reshape(-1, 2)
        code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(tokens)), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
        out = np.bincount(row * self._dim + places[code, 0], weights=places[code, 1], minlength=len(tokens) * self._dim).reshape(-1, self._dim)
        size = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return out / np.where(size > 1e-9, size, 1.0)


_places: dict[int, dict[str, tuple[int, int]]] = {}


class ServiceEncoder(Encoder):
    """Vectors from an embedding service with the common ``/embeddings`` interface; wrap it in ``RetryingEncoder``.

    Texts are cut to a token budget: exactly, with the tokenizer file of the model (readable on every executor), else by the estimate of
    three characters a token. Vectors come back in any order, with their index, and get length one. Refusals other than for length, haste or time
    are permanent.
    """

    def __init__(self, url: str, model: str, dim: int, key: str | None = None, context: int = 8192, timeout: float = 60.0, tokenizer: str | None = None):
        self.url, self.model, self._dim, self.key, self.timeout = url.rstrip("/"), model, dim, key, timeout
        self.budget, self.tokenizer = int(context * 0.95) - 16, tokenizer

    def cut(self, texts: Sequence[str]) -> list[str]:
        """Texts within the budget."""
        if self.tokenizer is None:
            return [t[: 3 * self.budget] for t in texts]
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(self.tokenizer)
        return [fitted(t, lambda x: len(library.encode(x).ids), self.budget) for t in texts]

    @property
    def name(self) -> str:
        return self.model

    @property
    def dim(self) -> int:
        return self._dim

    def encode(self, texts: Sequence[str]) -> list[np.ndarray | None]:
        import json
        import urllib.error
        import urllib.request

        body = json.dumps({"model": self.model, "input": self.cut(texts)}).encode()
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        try:
            with urllib.request.urlopen(urllib.request.Request(f"{self.url}/embeddings", body, headers), timeout=self.timeout) as reply:
                rows = json.load(reply)["data"]
        except urllib.error.HTTPError as error:
            said = error.read().decode("utf-8", "replace")
            lasting = 400 <= error.code < 500 and error.code not in (408, 413, 429) and not OVERFLOW.search(said)
            raise (PermanentError if lasting else RuntimeError)(said) from error
        out: list[np.ndarray | None] = [None] * len(texts)
        for row in rows:
            vector = np.array(row["embedding"], dtype=np.float64)
            if len(vector) != self._dim:
                raise PermanentError(f"the service gave {len(vector)} dimensions, {self._dim} are set")
            size = np.sqrt((vector * vector).sum())
            out[row["index"]] = vector / (size if size > 1e-9 else 1.0)
        return out


def create_encoder(settings) -> Encoder:
    """The encoder of an ``EmbeddingConfig``: the named service where a url is set, else feature hashing."""
    if settings.url:
        service = ServiceEncoder(settings.url, settings.model, settings.dim, settings.key or None, settings.context)
        return RetryingEncoder(service, settings.max_retries, wait=1.0)
    if settings.model != "hashing":
        raise ValueError(f"no url is set for the model {settings.model!r}")
    return HashingEncoder(settings.dim)


#: Phrases by which a service says that a text is too long.
OVERFLOW = re.compile("context length|input_tokens|too many tokens", re.IGNORECASE)


class RetryingEncoder(Encoder):
    """Wraps an encoder that may fail: batches are retried, then single texts, each time after a longer pause; texts that are too long shrink. Permanent
    failures are raised at once."""

    def __init__(self, inner: Encoder, retries: int = 3, shrink: float = 0.8, floor: int = 256, most_shrinks: int = 8, wait: float = 0.0):
        self.inner, self.retries, self.shrink, self.floor, self.most_shrinks, self.wait = inner, retries, shrink, floor, most_shrinks, wait

    @property
    def name(self) -> str:
        return self.inner.name

    @property
    def dim(self) -> int:
        return self.inner.dim

    def encode(self, texts: Sequence[str]) -> list[np.ndarray | None]:
        for attempt in range(self.retries):
            try:
                return self.inner.encode(texts)
            except PermanentError:
                raise
            except Exception as error:  # the wrapped service decides what it raises
                if OVERFLOW.search(str(error)):
                    break
                time.sleep(self.wait * 2**attempt)
        return [self._single(text) for text in texts]

    def _single(self, text: str) -> np.ndarray | None:
        failures = shrinks = 0
        while failures < self.retries:
            try:
                return self.inner.encode([text])[0]
            except PermanentError:
                raise
            except Exception as error:
                if OVERFLOW.search(str(error)) and shrinks < self.most_shrinks and len(text) > self.floor:
                    text = text[: max(self.floor, int(len(text) * self.shrink))]
                    shrinks += 1
                else:
                    time.sleep(self.wait * 2**failures)
                    failures += 1
        return None


def _lists(matrix: np.ndarray) -> pa.ListArray:
    """Rows of a matrix as lists."""
    offsets = np.arange(0, matrix.size + 1, max(1, matrix.shape[1]), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix, dtype=np.float64).ravel()))


def encoded(rows: DataFrame, encoder: Encoder, text: str = "content", batch: int = 512) -> DataFrame:
    """``rows`` with a column ``vector`` (null where encoding failed) and ``embed_error``.

    An encoder that works on tokens gets those of the built-in tokenizer, as Arrow lists; texts are cut where they are encoded.
    """
    if hasattr(encoder, "encode_tokens"):

        def of_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                *kept, texts = part.columns
                yield pa.RecordBatch.from_arrays([*kept, _lists(encoder.encode_tokens(token_lists(texts)))], names=[*part.schema.names[:-1], "vector"])

        schema = T.StructType([*rows.schema.fields, T.StructField("vector", T.ArrayType(T.DoubleType()))])
        made = rows.select("*", F.col(text).alias("text_")).mapInArrow(of_tokens, schema)
        return made.withColumn("embed_error", F.lit(None).cast("string"))
    kind = T.StructType([T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("embed_error", T.StringType())])

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            values = texts.fillna("").tolist()
            vectors = [v for k in range(0, len(values), batch) for v in encoder.encode(values[k : k + batch])]
            bad = [None if v is not None else "not encoded" for v in vectors]
            yield pd.DataFrame({"vector": [None if v is None else v.tolist() for v in vectors], "embed_error": bad})

    return rows.withColumn("e", run(F.col(text))).select(*rows.columns, "e.vector", "e.embed_error")


def prepared(vectors: DataFrame, metric: str = "ip") -> DataFrame:
    """Vectors as they are stored: of length one for the inner product."""
    return vectors.withColumn("vector", normalize("vector").cast("array<float>")) if metric == "ip" else vectors


def in_namespaces(vectors: DataFrame, only: Sequence | None = None, without: Sequence | None = None) -> DataFrame:
    """Vectors of some namespaces, or of all others; reaches the scan as a filter."""
    if only is not None:
        vectors = vectors.where(F.col("namespace").isin(list(only)))
    if without is not None:
        vectors = vectors.where(~F.col("namespace").isin(list(without)))
    return vectors


def nearest(vectors: DataFrame, query: Sequence[float], k: int, metric: str = "ip") -> DataFrame:
    """(chunk_id, namespace, score, rank) of the k best vectors for one query, as an expression over the scan."""
    literal = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.where("vector IS NOT NULL").select(
        "chunk_id", "namespace", F.round(similarity("vector", literal, metric), SCORE_PLACES).alias("score")
    )
    best = scored.orderBy(F.desc("score"), "chunk_id").limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "chunk_id")))  # k rows


def _matrices(columns: list[str], most: int):
    """Rows (*columns, vector) become rows (*columns as lists, dim, matrix) of ``most`` vectors of one length at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}

        def close(dim: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(parts).combine_chunks()
            for at in range(0, len(rows), most):
                part = rows.slice(at, most)
                matrix = part.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
                lists = [pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column(c).combine_chunks()) for c in columns]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([dim], pa.int32()), pa.array([matrix.tobytes()], pa.binary())], names=[*columns, "dim", "matrix"])

        for batch in batches:
            length = pc.list_value_length(batch.column(len(columns)))
            for dim in pc.unique(length).to_pylist():
                part = batch.filter(pc.equal(length, dim))
                held.setdefault(dim, []).append(part)
                if sum(len(p) for p in held[dim]) >= most:
                    yield from close(dim, held.pop(dim))
        for dim, parts in held.items():
            yield from close(dim, parts)

    return run


def _scores(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Similarity of every row of ``x`` with every row of ``y``, rounded as scores are."""
    score = x @ y.T
    if metric == "cosine":
        size = np.sqrt((x * x).sum(axis=1))[:, None] * np.sqrt((y * y).sum(axis=1))[None, :]
        score = np.where(size > 0, score / np.where(size > 0, size, 1), np.nan)
    elif metric == "l2":
        score = 1 / (1 + np.maximum(0, (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * score))
    return np.round(score, SCORE_PLACES)


def _best(k: int, metric: str, stored_kind: str, asked_kind: str, schema: pa.Schema):
    """Rows of a stored matrix and a query matrix become the ``k`` best of each query in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, pd.DataFrame] = {}
        asked: dict[int, tuple] = {}
        for batch in batches:
            names = batch.schema.names
            for row in range(batch.num_rows):
                at = {name: batch.column(i)[row] for i, name in enumerate(names)}
                dim, block = at["dim"].as_py(), at["block"].as_py()
                if dim != at["asked_dim"].as_py():
                    continue
                if block not in asked:
                    asked[block] = (
                        at["query_id"].as_py(), np.frombuffer(at["asked_matrix"].as_buffer(), asked_kind).reshape(-1, dim).astype(np.float64), at["only"].as_py(), at["without"].as_py(),
                    )
                ids, matrix, only, without = asked[block]
                stored = np.frombuffer(at["matrix"].as_buffer(), stored_kind).reshape(-1, dim).astype(np.float64)
                namespace = pd.Series(at["namespace"].as_py(), dtype=object)
                if any(x is not None for x in only) or any(x is not None for x in without):
                    own = namespace.to_numpy()[:, None]
                    wanted, barred = (np.array([[x] for x in names_], dtype=object).reshape(1, -1) for names_ in (only, without))
                    allowed = np.array([[x is None for x in only]]) | (own == wanted)
                    allowed &= ~(np.array([[x is not None for x in without]]) & (own == barred))
                    score = np.where(allowed, np.nan_to_num(_scores(stored, matrix, metric), nan=-np.inf), -np.inf)
                else:
                    score = np.nan_to_num(_scores(stored, matrix, metric), nan=-np.inf)
                n = min(k, len(stored))
                # all rows that reach the k-th best, so ties are decided by id below
                least = -np.partition(-score, n - 1, axis=0)[n - 1]
                i, q = np.nonzero((score >= least) & (score > -np.inf))
                found = pd.DataFrame({"q": q, "chunk_id": np.array(at["chunk_id"].as_py(), dtype=object)[i], "namespace": namespace.to_numpy()[i], "score": score[i, q]})
                found = found if block not in best else pd.concat([best[block], found])
                best[block] = found.sort_values(["q", "score", "chunk_id"], ascending=[True, False, True]).groupby("q").head(k)
        for block, found in best.items():
            ids = asked[block][0]
            columns = [[ids[q] for q in found["q"]], found["chunk_id"].tolist(), found["namespace"].tolist(), found["score"].to_numpy()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def batch_nearest(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "ip") -> DataFrame:
    """(query_id, chunk_id, namespace, score, rank): the k best vectors for each of the queries (query_id, vector).

    Queries may have a column ``only`` (the one namespace to search, null for all) and a column ``without`` (a namespace to leave out). Of equal scores
    the lesser chunk_id comes first. Null and empty vectors, and vectors of another length than the query's, are no neighbours. The queries are counted first: up to
    MOST_ASKED_BYTES of them, whose best rows are MOST_BEST_ROWS at most, meet all vectors in one scan; more take further scans.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    def kept(rows: DataFrame) -> tuple[Column, str]:
        single = rows.schema["vector"].dataType.elementType.simpleString() == "float"
        kind = "float" if single else "double"
        return F.col("vector").cast(f"array<{kind}>").alias("vector"), "<f4" if single else "<f8"

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    asked_kind, spaces = queries.schema["query_id"].dataType.simpleString(), kinds["namespace"]
    vector, stored_kind = kept(vectors)
    stored = vectors.where(F.size("vector") > 0).select("chunk_id", "namespace", vector)
    stored = stored.mapInArrow(
        _matrices(["chunk_id", "namespace"], STORED_BLOCK), f"chunk_id array<{kinds['chunk_id']}>, namespace array<{spaces}>, dim int, matrix binary"
    )
    vector, query_kind = kept(queries)
    filters = [(F.col(c).cast(spaces) if c in queries.columns else F.lit(None).cast(spaces)).alias(c) for c in ("only", "without")]
    schema = f"query_id {asked_kind}, chunk_id {kinds['chunk_id']}, namespace {spaces}, score double"
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))
    parts = []
    for part, rows in _passes(queries.where(F.size("vector") > 0).select("query_id", *filters, vector), k):
        asked = part.repartition(max(1, rows // QUERY_BLOCK)).mapInArrow(
            _matrices(["query_id", "only", "without"], QUERY_BLOCK), f"query_id array<{asked_kind}>, only array<{spaces}>, without array<{spaces}>, dim int, matrix binary"
        ).select(F.monotonically_increasing_id().alias("block"), "query_id", "only", "without", F.col("dim").alias("asked_dim"), F.col("matrix").alias("asked_matrix"))
        parts.append(stored.crossJoin(F.broadcast(asked)).mapInArrow(_best(k, metric, stored_kind, query_kind, arrow), schema))
    found = reduce(DataFrame.unionByName, parts)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _passes(asked: DataFrame, k: int, most_bytes: int | None = None, most_rows: int | None = None) -> list[tuple[DataFrame, int]]:
    """Queries as parts with their numbers of rows, each small enough to be broadcast and to have its ``k`` best rows held by a task.

    The queries are worked out once and counted. Parts are dealt by a hash of the query, and into twice as many as long as one is too large.
    """
    most_bytes, most_rows = most_bytes or MOST_ASKED_BYTES, most_rows or MOST_BEST_ROWS
    shared_folder(asked.sparkSession)
    asked = asked.checkpoint()
    number = 1
    while True:
        place = F.pmod(F.xxhash64("query_id"), F.lit(number))
        sizes = asked.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("vector")).alias("cells")).collect()
        whole = all((r["cells"] * 8 <= most_bytes and r["rows"] * k <= most_rows) or r["rows"] == 1 for r in sizes)
        if whole or number >= sum(r["rows"] for r in sizes):
            return [(asked.where(place == r["place"]), r["rows"]) for r in sizes] or [(asked, 0)]
        number *= 2


def _calibrated(near: np.ndarray, far: np.ndarray, target: float) -> tuple[float, float]:
    """The shortest bucket length that keeps the target share of true neighbours, and the share of all rows that it leaves.

    ``near`` (queries, neighbours, tables) and ``far`` (queries, rows, tables) hold a query's projection and another row's, in pairs.
    The target has to hold two standard errors below the mean over the queries.
    """

    def met(pairs: np.ndarray, bucket: float) -> np.ndarray:
        place = np.floor(pairs / bucket)
        return (place[..., 0] == place[..., 1]).any(axis=-1).mean(axis=1)

    for bucket in np.geomspace(1e-3, 2, 45):
        kept = met(near, bucket)
        if kept.mean() - 2 * kept.std() / np.sqrt(len(kept)) >= target:
            return float(bucket), float(met(far, bucket).mean())
    return 2.0, 1.0


def approximate_nearest(vectors: DataFrame, queries: DataFrame, k: int, tables: int = 8, bucket: float | None = None, recall: float = 0.9) -> DataFrame:
    """Approximate neighbours by random-projection hashing (built-in): (query_id, chunk_id, score, rank) with the cosine as score.

    Optional, for stores where reading all vectors for each block is too much. Both sides are normalized first; vectors without a length
    have no cosine and are left out. Unless ``bucket`` states a bucket length, the shortest one that reaches ``recall`` is taken, measured
    against the exact search on CALIBRATION_QUERIES queries. Where that leaves more than MOST_LEFT of all rows, as it does
    where the neighbours are hardly nearer than the other rows, hashing saves nothing and the exact search answers; it also answers
    for so few queries, and for each query with fewer than k candidates.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    def unit(rows: DataFrame, key: str) -> DataFrame:
        return rows.where(norm("vector") > 1e-9).select(key, array_to_vector(normalize("vector")).alias("features"))

    def exact(some: DataFrame) -> DataFrame:
        return batch_nearest(vectors.where(norm("vector") > 1e-9), some, k, "cosine").select("query_id", "chunk_id", "score", "rank")

    def hashing(length: float):
        kind = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=length, numHashTables=tables, seed=7)
        return kind.fit(stored)

    queries = queries.where(norm("vector") > 1e-9)
    stored, asked = unit(vectors, "chunk_id"), unit(queries, "query_id")
    total = stored.count()
    if bucket is None:
        sample = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(CALIBRATION_QUERIES + 1).select("query_id", "vector").toPandas()
        if len(sample) <= CALIBRATION_QUERIES or total <= k:
            return exact(queries)
        spark, fine = queries.sparkSession, 1e-9
        some = spark.createDataFrame(sample[:CALIBRATION_QUERIES], queries.select("query_id", "vector").schema)
        model = hashing(fine)  # the directions depend on the seed only, so these hashes are the projections

        def projected(rows: DataFrame, key: str) -> DataFrame:
            hashes = model.transform(unit(rows, key)).select(key, "hashes")
            return hashes.select(key, F.transform("hashes", lambda h: vector_to_array(h)[0] * fine).alias("p"))

        best = pd.DataFrame(exact(some).select("query_id", "chunk_id").collect(), columns=["query_id", "chunk_id"])  # k rows a query
        found = vectors.where(F.col("chunk_id").isin(best["chunk_id"].unique().tolist()))
        near = dict(projected(found, "chunk_id").collect())
        seen = dict(projected(some, "query_id").collect())
        rest = vectors.select("chunk_id", "vector").orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(CALIBRATION_ROWS)
        far = [r["p"] for r in projected(rest, "chunk_id").collect()]
        asks = list(seen)
        own = np.array([seen[q] for q in asks])[:, None, :]
        near = np.array([[near[c] for c in best.loc[best["query_id"] == q, "chunk_id"]] for q in asks])
        pairs = (np.stack(np.broadcast_arrays(own, x), axis=-1) for x in (near, np.array(far)[None, :, :]))
        bucket, left = _calibrated(*pairs, recall)
        if left > MOST_LEFT:
            return exact(queries)
    # no two unit vectors are further apart than 2, so the limit drops nothing
    pairs = hashing(bucket).approxSimilarityJoin(stored, asked, 3.0, distCol="distance")
    scored = pairs.select(
        F.col("datasetB.query_id").alias("query_id"),
        F.col("datasetA.chunk_id").alias("chunk_id"),
        F.round(1 - F.col("distance") * F.col("distance") / 2, SCORE_PLACES).alias("score"),
    )
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    (found,) = kept(queries.sparkSession, found=scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
    full = found.where(F.col("rank") == min(k, total)).select("query_id")
    return found.join(full, "query_id", "left_semi").unionByName(exact(queries.join(full, "query_id", "left_anti")))
