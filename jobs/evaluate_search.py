"""Measure how well keyword search finds the documents that hold known passages.

    python -m jobs.evaluate_search [--config FILE] DOCUMENTS PASSAGES TARGET

Each passage is a query. The ``depth`` best documents by BM25 are taken, and those that hold the passage word for word count as relevant (judging what was
retrieved, as pooled evaluations do). Below TARGET, by category of query: ``results`` (the ranked documents with scores and judgements) and
``quality`` (NDCG at ``k``, the first relevant rank, and the share of relevant documents read within each budget of tokens).

``work`` holds lengths, counts of the queries' tokens and what was found. A run replaces the categories that it writes, so running it again leaves the same files' contents. The configuration gives SQL expressions over the
columns of the two tables.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratasearch.functions.text import approx_tokens
from stratasearch.operators import bm25, evaluation

log = logging.getLogger("evaluate_search")

DEFAULTS = Path(__file__).with_suffix(".json")
RESULTS = "query_id long, rank int, doc_id long, repo_id string, score double, relevant boolean, n_tokens long, category string"
QUALITY = "query_id long, n_relevant long, first_rank int, ndcg double, recall array<double>, category string"


def written(rows: DataFrame, path: str, schema: str) -> DataFrame:
    """Write by category, replacing only the categories that come, and read back."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("category").parquet(path)
    return rows.sparkSession.read.schema(schema).parquet(path)


def ranked(documents: DataFrame, queries: DataFrame, depth: int, work: str) -> DataFrame:
    """(query_id, rank, chunk_id, repo_id, score) of the best documents (chunk_id, repo_id, file_path, content).

    The length of each document and its counts of the queries' tokens are kept below ``work``, and so are the few rows that are found: the texts are joined with those.
    """
    found = bm25.best_in(queries, bm25.texts_of(documents), depth, work=f"{work}/counts")
    found.write.mode("overwrite").parquet(f"{work}/ranked")
    return documents.sparkSession.read.schema(found.schema).parquet(f"{work}/ranked")


def run(spark: SparkSession, documents: str, passages: str, target: str, settings: dict | None = None) -> DataFrame:
    """Evaluate; returns ``quality`` as written."""
    settings = json.loads(DEFAULTS.read_text()) | (settings or {})
    chunk = F.lpad(F.expr(settings["id"]).cast("string"), 19, "0").alias("chunk_id")
    rows = spark.read.parquet(documents).select(
        chunk,
        F.expr(settings["id"]).cast("long").alias("doc_id"),
        F.expr(settings["repo"]).cast("string").alias("repo_id"),
        F.expr(settings["path"]).alias("file_path"),
        F.coalesce(F.expr(settings["content"]), F.lit("")).alias("content"),
    )
    queries = spark.read.parquet(passages).select(
        F.expr(settings["query_id"]).cast("long").alias("query_id"),
        F.expr(settings["query"]).alias("query"),
        F.coalesce(F.expr(settings["category"]), F.lit("none")).alias("category"),
    )
    queries = queries.where("query_id IS NOT NULL AND query <> ''")
    found = ranked(rows, queries, settings["depth"], f"{target}/work")
    holds = F.contains("content", F.col("query")).alias("relevant")
    texts = rows.select("chunk_id", "doc_id", "content")
    judged = found.join(texts, "chunk_id").join(queries, "query_id").select(
        "query_id", F.col("rank").cast("int").alias("rank"), "doc_id", "repo_id", F.round("score", 6).alias("score"), holds, approx_tokens("content").cast("long").alias("n_tokens"), "category"
    )
    results = written(judged, f"{target}/results", RESULTS)

    hits = results.where("relevant").select("query_id", F.col("doc_id").alias("target_id"), "rank")
    totals = queries.join(hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant")), "query_id", "left").select(
        "query_id", "category", F.coalesce("n_relevant", F.lit(0)).cast("long").alias("n_relevant")
    )
    curve = evaluation.curves(results.select("query_id", "rank", "n_tokens"), hits)
    recalls = evaluation.recall_at_budget(curve, totals.select("query_id", "n_relevant"), settings["budgets"])
    recall = recalls.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("budget", F.round("recall", 6).alias("recall")))).alias("all"))
    first = hits.groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    quality = (
        totals.join(evaluation.ndcg(hits, totals.select("query_id", "n_relevant"), settings["k"]), "query_id")
        .join(recall, "query_id")
        .join(first, "query_id", "left")
        .select("query_id", "n_relevant", "first_rank", F.round("ndcg", 6).alias("ndcg"), F.transform("all", lambda x: x["recall"]).alias("recall"), "category")
    )
    out = written(quality, f"{target}/quality", QUALITY)
    for row in out.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.avg("ndcg").alias("ndcg")).orderBy("category").collect():
        log.info("%s: %d queries, NDCG@%d %.4f", row["category"], row["n"], settings["k"], row["ndcg"])
    log.info("read %d documents and %d queries; wrote %d results", rows.count(), queries.count(), results.count())
    return out


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    parser.add_argument("--config", default=str(DEFAULTS))
    for name in ("documents", "passages", "target"):
        parser.add_argument(name)
    given = parser.parse_args(arguments)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s: %(message)s")
    settings = json.loads(Path(given.config).read_text())
    spark = SparkSession.builder.appName("evaluate_search").getOrCreate()
    try:
        run(spark, given.documents, given.passages, given.target, settings)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
