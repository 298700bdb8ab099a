"""Search and find-related as plans over the tables, for any number of queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..operators import bm25, dense, fusion, ranking
from ..operators.lookups import resolve_candidates
from ..sources.tables import kept


def scoped(queries: DataFrame) -> DataFrame:
    """Queries with a column ``scope`` (a repo_id, or null for all)."""
    return queries if "scope" in queries.columns else queries.withColumn("scope", F.lit(None).cast("string"))


def not_blank(queries: DataFrame) -> DataFrame:
    """Queries with more than white space; the others have no results."""
    return queries.where(~is_blank("query"))


def sparse_hits(
    queries: DataFrame, postings: DataFrame | None, stats: DataFrame | None, coarse: int, prefilter: bool = False, tokens: DataFrame | None = None
) -> DataFrame:
    """The coarse BM25 hits of each query.

    A query with a scope keeps those of the coarse hits that are in its repository; with ``prefilter`` it gets the best hits of the
    repository instead, however they rank among all. ``tokens`` (chunk_id, repo_id, tokens; or ``texts_of``) may stand for postings and statistics, without ``prefilter``.
    """
    if tokens is not None:
        if prefilter:
            raise ValueError("a search from tokens ranks all chunks before a scope applies")
        hits = bm25.best_in(queries, tokens, coarse).join(scoped(queries).select("query_id", "scope"), "query_id")
        return hits.where(F.col("scope").isNull() | (F.col("scope") == F.col("repo_id"))).select("query_id", "chunk_id", "score")
    scored = bm25.scores(queries, postings, stats).join(scoped(queries).select("query_id", "scope"), "query_id")
    inside = F.col("scope").isNull() | (F.col("scope") == F.col("repo_id"))
    hits = bm25.top(scored.where(inside), coarse) if prefilter else bm25.top(scored, coarse).where(inside)
    return hits.select("query_id", "chunk_id", "score")


def dense_hits(vectors: DataFrame, encoded: DataFrame, coarse: int, metric: str = "ip") -> DataFrame:
    """The coarse nearest vectors of each query (query_id, scope, vector); a scope is applied before the best are taken."""
    asked = encoded.select("query_id", F.col("scope").alias("only"), "vector")
    return dense.batch_nearest(vectors, asked, coarse, metric).select("query_id", "chunk_id", "score")


def search(
    queries: DataFrame,
    chunks: DataFrame,
    vectors: DataFrame,
    postings: DataFrame | None,
    stats: DataFrame | None,
    repos: DataFrame,
    encoder: dense.Encoder,
    top_k: int = 5,
    coarse_multiplier: int = 5,
    alpha: float | None = None,
    prefilter: bool = False,
    metric: str = "ip",
    outside: bool = False,
    tokens: DataFrame | None = None,
) -> DataFrame:
    """The best chunks for each query (query_id, query, and scope if wanted): both retrievals, fusion, ranking.

    Blank queries have no results. ``outside`` lets chunks in that define a queried symbol but were not retrieved, in the repositories
    that have candidates. ``tokens`` of all chunks stand for postings and statistics: for a batch over chunks that have none; what is found is kept then.
    """
    asked = not_blank(scoped(queries)).select("query_id", "query", "scope")
    coarse = max(coarse_multiplier * top_k, top_k)
    encoded = dense.encoded(asked, encoder, "query").select("query_id", "scope", "vector")
    near = dense_hits(vectors, encoded, coarse, metric)
    sparse = sparse_hits(asked, postings, stats, coarse, prefilter, tokens)
    if tokens is not None:
        near, sparse = kept(queries.sparkSession, near=near, sparse=sparse)
    given = None if alpha is None else F.lit(alpha)
    fused = fusion.fuse(near, sparse, asked.select("query_id", fusion.alpha_of("query", given).alias("alpha")))
    if tokens is not None:  # a few rows a query, so that the chunks are joined where they are
        (fused,) = kept(queries.sparkSession, fused=fused)
    candidates = resolve_candidates(fused, chunks, repos).join(asked.select("query_id", "query"), "query_id")
    every = resolve_candidates(chunks.select("chunk_id"), chunks, repos) if outside else None
    return results(ranking.rank_candidates(candidates, top_k, all_chunks=every))


def related(
    seeds: DataFrame, chunks: DataFrame, vectors: DataFrame, repos: DataFrame, top_k: int = 5, exclude_own: bool = True, metric: str = "ip"
) -> DataFrame:
    """The chunks most like each seed (query_id, chunk_id, repo_id, vector), by raw similarity, path penalties and saturation.

    ``exclude_own`` leaves the seed's repository out; the seed itself never comes back.
    """
    coarse = 5 * top_k + 1
    own = F.col("repo_id") if exclude_own else F.lit(None).cast("string")
    found = dense.batch_nearest(vectors, seeds.select("query_id", own.alias("without"), "vector"), coarse, metric)
    hits = found.select("query_id", "chunk_id", "score")
    others = hits.join(seeds.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    candidates = resolve_candidates(others, chunks, repos)
    return results(ranking.rank_candidates(candidates, top_k, query_boosts=False))


def results(ranked: DataFrame) -> DataFrame:
    """The columns of a result; the chunk is nested."""
    return ranked.select(
        "query_id",
        F.col("rank").cast("int").alias("rank"),
        "score",
        "repo_id",
        "repo_name",
        "repo_source",
        "chunk_id",
        F.struct("content", "file_path", "start_line", "end_line", "language").alias("chunk"),
    )


def rendered(found: DataFrame) -> DataFrame:
    """(query_id, rank, block): each result as a heading and a fenced block."""
    heading = F.format_string(
        "## %d. %s :: %s:%d-%d  [score=%.3f]", "rank", "repo_name", "chunk.file_path", "chunk.start_line", "chunk.end_line", "score"
    )
    source = F.when(F.col("repo_source") == "", F.lit("")).otherwise(F.concat(F.lit("repo: "), "repo_source", F.lit("\n")))
    body = F.regexp_replace(F.col("chunk.content"), r"(?U)^\s+|\s+$", "")
    return found.select("query_id", "rank", F.concat(heading, F.lit("\n"), source, F.lit("```\n"), body, F.lit("\n```\n")).alias("block"))


def to_wire(found: DataFrame) -> DataFrame:
    """Results as JSON texts."""
    kept = [c for c in found.columns if c not in ("query_id", "rank")]
    return found.select("query_id", "rank", F.to_json(F.struct(*kept), {"ignoreNullFields": "false"}).alias("json"))


def from_wire(rows: DataFrame) -> DataFrame:
    """Results back from their JSON texts."""
    kind = (
        "score double, repo_id string, repo_name string, repo_source string, chunk_id string, "
        "chunk struct<content:string,file_path:string,start_line:int,end_line:int,language:string>"
    )
    return rows.select("query_id", "rank", F.from_json("json", kind).alias("r")).select("query_id", "rank", "r.*")
