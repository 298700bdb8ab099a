"""The jobs as registered queries: each is run twice into one new folder below the shared one, and its output is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratasearch.plans import sql_text as s
from stratasearch.sources.tables import shared_folder

from . import evaluate_search, index_documents

_FILES = "files AS (SELECT doc_id, source AS repo_id, lang || '/' || doc_id || '.txt' AS file_path, lang AS language, coalesce(text, '') AS content FROM documents)"


def _new_folder(spark: SparkSession, job: str) -> str:
    return f"{shared_folder(spark)}/jobs/{job}-{uuid.uuid4().hex}"


def job1_index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the index that counts after two runs; the second finds nothing new."""
    base = _new_folder(spark, "index_documents")
    for _ in range(2):
        index_documents.run(spark, f"{sf_dir}/documents.parque[t]", f"{base}/index", f"{base}/checkpoint")  # a pattern may name a single file
    return index_documents.current(spark, f"{base}/index").select(
        "doc_id", "repo_id", "chunk_id", "file_path", "language", "start_line", "end_line", "content_hash", "n_tokens", "n_terms"
    )


def job2_evaluate_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ranked result with the quality of its query."""
    base = _new_folder(spark, "evaluate_search")
    for _ in range(2):
        quality = evaluate_search.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", base)
    results = spark.read.schema(evaluate_search.RESULTS).parquet(f"{base}/results")
    shown = quality.select("query_id", "category", "n_relevant", "first_rank", "ndcg", *[F.col("recall")[k].alias(f"recall_{k}") for k in range(3)])
    return results.drop("category").join(shown, "query_id", "right")


QUERIES = {"job1_index_documents": job1_index_documents, "job2_evaluate_search": job2_evaluate_search}

_MINIFIED = f"length(left(content, 65536)) / CAST({s.newlines('left(content, 65536)')} + 1 AS DOUBLE) > 2000"

ORACLE_SQL = {
    "job1_index_documents": f"""
        WITH RECURSIVE {s.chunked().replace(s.FILES, _FILES)},
        t AS (SELECT *, {s.index_tokens('content', 'file_path')} AS tokens FROM pieces WHERE doc_id NOT IN (SELECT doc_id FROM files WHERE {_MINIFIED}))
        SELECT doc_id, repo_id, {s.CHUNK_ID} AS chunk_id, file_path, language, start_line, end_line, left(sha256(content), 32) AS content_hash,
          CAST(len(tokens) AS BIGINT) AS n_tokens, CAST(len(list_distinct(tokens)) AS BIGINT) AS n_terms FROM t
    """,
    "job2_evaluate_search": f"""
        WITH {s.TOKENS.replace(s.FILES, _FILES).replace("'d' || lpad(CAST(doc_id AS VARCHAR), 9, '0')", "lpad(CAST(doc_id AS VARCHAR), 19, '0')")},
        q AS (SELECT item_id AS query_id, text AS query, CASE WHEN length(text) < 200 THEN 'short' WHEN length(text) < 400 THEN 'medium' ELSE 'long' END AS category
          FROM benchmark WHERE text <> ''),
        {s.bm25()}, {s.top('bm', 20, 't')},
        r AS (SELECT t.query_id, CAST(t.rank AS INTEGER) AS rank, u.doc_id, u.repo_id, round(t.score, 6) AS score, contains(u.content, q.query) AS relevant,
          CAST(greatest(1, length(u.content) // 3) AS BIGINT) AS n_tokens FROM t JOIN units u USING (chunk_id) JOIN q USING (query_id)),
        c AS (SELECT *, sum(n_tokens) OVER w AS used, count(*) FILTER (relevant) OVER w AS covered FROM r WINDOW w AS (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING)),
        m AS (SELECT query_id, count(*) FILTER (relevant) AS n_relevant, min(rank) FILTER (relevant) AS first_rank,
          coalesce(sum(1e0 / log2(rank + 1e0)) FILTER (relevant AND rank <= 10), 0) AS dcg,
          {", ".join(f"coalesce(max(covered) FILTER (used <= {b}), 0) AS c{k}" for k, b in enumerate((500, 2000, 8000)))} FROM c GROUP BY query_id),
        z AS (SELECT q.query_id, category, CAST(coalesce(n_relevant, 0) AS BIGINT) AS n_relevant, first_rank,
          round(CASE WHEN n_relevant > 0 THEN dcg / list_sum(list_transform(range(1, least(n_relevant, 10) + 1), lambda k: 1e0 / log2(k + 1e0))) ELSE 0e0 END, 6) AS ndcg,
          {", ".join(f"round(CASE WHEN n_relevant > 0 THEN c{k} / CAST(n_relevant AS DOUBLE) ELSE 0e0 END, 6) AS recall_{k}" for k in range(3))}
          FROM q LEFT JOIN m USING (query_id))
        SELECT z.query_id, rank, doc_id, repo_id, score, relevant, n_tokens, category, n_relevant, first_rank, ndcg, recall_0, recall_1, recall_2
        FROM z LEFT JOIN r USING (query_id)
    """,
}
