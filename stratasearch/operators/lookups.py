"""Joins of retrieval: ids to chunks, lines to chunks, paths to repositories, differences of id sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import same_file
from ..functions.text import display_name, is_git_url


def resolve_candidates(fused: DataFrame, chunks: DataFrame, repos: DataFrame) -> DataFrame:
    """Fused ids with their chunks and repositories; ids without a chunk are dropped, chunks without a repository keep an empty source."""
    named = repos.select("repo_id", "source")
    source = F.coalesce("source", F.lit(""))
    return (
        fused.join(chunks, "chunk_id")
        .join(named, "repo_id", "left")
        .withColumn("repo_source", source)
        .withColumn("repo_name", F.when(F.col("repo_source") == "", F.col("repo_id")).otherwise(display_name("repo_source")))
        .drop("source")
    )


def only_in(ids: DataFrame, other: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows whose id is not in the other table."""
    return ids.join(other.select(key).distinct(), key, "left_anti")


def also_in(ids: DataFrame, other: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows whose id is in the other table."""
    return ids.join(other.select(key).distinct(), key, "left_semi")


def either(ids: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of one table or the other, each once."""
    return ids.unionByName(other).distinct()


def both(ids: DataFrame, other: DataFrame) -> DataFrame:
    """Rows that both tables have, each once."""
    return ids.intersect(other)


def first_of_each(rows: DataFrame, by: str, order: str) -> DataFrame:
    """(by, first): the least ``order`` of each value, which is what dropping repeats in that order keeps. Nothing is sorted as a whole."""
    return rows.groupBy(by).agg(F.min(order).alias("first"))


def chunk_at_line(chunks: DataFrame, places: DataFrame) -> DataFrame:
    """For each place (place_id, repo_id, file_path, line): the chunk that holds the line and ends first.

    An equi-join on the file with the range as its condition; places that no chunk holds are missing.
    """
    inside = (F.col("start_line") <= F.col("line")) & (F.col("line") <= F.col("end_line"))
    order = W.partitionBy("place_id").orderBy("end_line", "chunk_id")
    found = places.join(chunks, ["repo_id", "file_path"]).where(inside)
    return found.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def chunk_at_line_inner(chunks: DataFrame, places: DataFrame) -> DataFrame:
    """The other rule: the first chunk (by start) that goes on beyond the line, else the first that ends at it."""
    inside = (F.col("start_line") <= F.col("line")) & (F.col("line") <= F.col("end_line"))
    order = W.partitionBy("place_id").orderBy((F.col("line") == F.col("end_line")).cast("int"), "start_line", "chunk_id")
    found = places.join(chunks, ["repo_id", "file_path"]).where(inside)
    return found.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def covered_targets(results: DataFrame, targets: DataFrame) -> DataFrame:
    """(query_id, target_id, rank) of each result (query_id, rank, file_path, start_line, end_line) that covers a target of its query.

    Targets: query_id, target_id, path, from_line, to_line (null: the whole file).
    """
    spans = F.col("from_line").isNull() | F.col("to_line").isNull()
    overlap = ~((F.col("end_line") < F.col("from_line")) | (F.col("start_line") > F.col("to_line")))
    return (
        results.join(targets, "query_id")
        .where(same_file(F.col("file_path"), F.col("path")) & (spans | overlap))
        .select("query_id", "target_id", "rank")
    )


def containing_repo(paths: DataFrame, repos: DataFrame) -> DataFrame:
    """For each path (path_id, path): the repository whose directory is the path or the deepest one above it.

    Every path asks for each of its ancestors by an equi-join, so no pair of path and repository is tried in vain. Remote addresses
    are found by equality only; of repositories at one directory the lesser id counts.
    """
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    asked = paths.withColumn("base", F.explode(F.when(is_git_url("path"), F.array("path")).otherwise(ancestors))).where("base <> ''")
    order = W.partitionBy("path_id").orderBy(F.desc(F.length("base")), "repo_id")
    found = asked.join(repos.select("repo_id", F.regexp_replace("source", "/+$", "").alias("base")), "base")
    return found.withColumn("k", F.row_number().over(order)).where("k = 1").select("path_id", "path", "repo_id")
