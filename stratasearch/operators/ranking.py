"""Code-aware ranking of candidates, for many queries in one plan.

Candidates have query_id, query, repo_id, chunk_id, file_path, content and score. All steps are windows over the query and the repository, and over a
file inside it; the data is dealt by (query_id, repo_id) once and every window reuses that. Files of two repositories never mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import parent_name, path_penalty, stem_of
from ..functions.text import defines, embedded_symbols, is_symbol_query, query_keywords, split_identifier, stem_matches, symbol_leaf
from .bm25 import SCORE_PLACES

# Factors of the ranking.
COHERENCE_SHARE = 0.2
DEFINITION_FACTOR, EMBEDDED_SHARE, STEM_FACTOR, DEFINED_AT_HOME = 3.0, 0.5, 1.0, 1.5
LEAST_RATIO, LEAST_PREFIX, LEAST_STEM = 0.10, 3, 4
SATURATION_DECAY = 0.5

_REPO = ("query_id", "repo_id")
_FILE = (*_REPO, "file_path")


def coherence_boost(candidates: DataFrame) -> DataFrame:
    """The best chunk of each file gains a share of the best score, by its file's sum against the greatest sum."""
    repo, file = W.partitionBy(*_REPO), W.partitionBy(*_FILE)
    summed = candidates.withColumns(
        {
            "best": F.max("score").over(repo),
            "file_sum": F.sum("score").over(file),
            "place": F.row_number().over(file.orderBy(F.desc("score"), "chunk_id")),
        }
    ).withColumn("top_sum", F.max("file_sum").over(repo))
    gain = COHERENCE_SHARE * F.col("best") * F.col("file_sum") / F.nullif(F.col("top_sum"), F.lit(0.0))
    boosted = F.when((F.col("place") == 1) & (F.col("best") != 0), F.col("score") + gain).otherwise(F.col("score"))
    return summed.withColumn("score", boosted).drop("best", "file_sum", "place", "top_sum")


def keyword_matches(keywords: Column, parts: Column) -> Column:
    """Keywords that equal a part, or of which one is a prefix of the other with three letters or more."""

    def near(k: Column, p: Column) -> Column:
        return (F.least(F.length(k), F.length(p)) >= LEAST_PREFIX) & (F.startswith(k, p) | F.startswith(p, k))

    return F.size(F.filter(keywords, lambda k: F.exists(parts, lambda p: (k == p) | near(k, p))))


def path_parts(path: Column | str) -> Column:
    """Identifier parts of a file's stem and of the directory that holds it."""
    parent = parent_name(path)
    above = F.when(parent == "", F.array().cast("array<string>")).otherwise(split_identifier(parent))
    return F.array_union(split_identifier(stem_of(path)), above)


def definition_gain(content: Column, stem: Column, names: Column, unit: Column) -> Column:
    """The unit where the text defines one of the names, half as much again where the file is named after one."""
    found = F.exists(names, lambda n: defines(content, n))
    home = F.exists(names, lambda n: stem_matches(stem, F.lower(n)))
    return F.when(found, unit * F.when(home, DEFINED_AT_HOME).otherwise(1.0)).otherwise(F.lit(0.0))


def stem_gain(query: Column, path: Column, unit: Column) -> Column:
    """The unit times the share of a query's keywords that the path holds, from a tenth on."""
    keywords = query_keywords(query)
    ratio = keyword_matches(keywords, path_parts(path)) / F.nullif(F.size(keywords), F.lit(0))
    return F.when(F.coalesce(ratio, F.lit(0.0)) >= LEAST_RATIO, unit * STEM_FACTOR * ratio).otherwise(F.lit(0.0))


def symbol_names(query: Column) -> Column:
    """The last identifier of a symbol query and the whole of it."""
    return F.array_distinct(F.array(symbol_leaf(query), F.trim(query)))


def query_boost(candidates: DataFrame) -> DataFrame:
    """Definitions of a queried symbol gain; for words, matching paths and definitions of symbols among the words do."""
    query, content = F.col("query"), F.col("content")
    stem = F.lower(stem_of("file_path"))
    best = F.max("score").over(W.partitionBy(*_REPO))
    unit = F.col("best") * DEFINITION_FACTOR
    symbol = definition_gain(content, stem, symbol_names(query), unit)
    words = stem_gain(query, F.col("file_path"), F.col("best")) + definition_gain(
        content, stem, embedded_symbols(query), unit * EMBEDDED_SHARE
    )
    gain = F.when(is_symbol_query(query), symbol).otherwise(words)
    return candidates.withColumn("best", best).withColumn("score", F.col("score") + gain).drop("best")


def outside_definitions(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks that aren't candidates but define the queried symbol in a file named after it, with that definition's score.

    Off in the default ranking. ``chunks``: repo_id, chunk_id, file_path, content. Queries are joined with chunks by repository and the forms of a
    file's stem: every query asks for the stems that fit its names, every chunk for its own stem's few forms, so no other pair is made.
    """
    asked = candidates.groupBy(*_REPO, "query").agg(F.max("score").alias("best"))
    symbolic = is_symbol_query("query")
    names = F.when(symbolic, symbol_names(F.col("query"))).otherwise(embedded_symbols("query"))
    lowered = F.transform("names", F.lower)
    prefixes = F.flatten(F.transform(lowered, lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.length(n) - LEAST_STEM, F.lit(0))), lambda k: F.substr(n, F.lit(1), F.greatest(F.length(n) - k, F.lit(LEAST_STEM))))))
    wanted = F.when(symbolic, F.array(F.lower(symbol_leaf("query")))).otherwise(F.array_distinct(F.concat(lowered, prefixes)))
    asking = asked.withColumn("names", names).withColumn("key", F.explode_outer(wanted)).where("key IS NOT NULL")
    stem = F.lower(stem_of("file_path"))
    plain = F.replace(stem, F.lit("_"), F.lit(""))
    forms = F.array_distinct(F.array(stem, plain, F.regexp_replace(stem, "s+$", ""), F.regexp_replace(plain, "s+$", "")))
    placed = chunks.withColumn("key", F.explode(forms))
    met = placed.join(asking, ["repo_id", "key"])
    own = (F.col("key") == stem) | (F.col("key") == plain)  # only a symbol may leave a plural ending out
    met = met.where(symbolic | own).drop("key").dropDuplicates(["query_id", "repo_id", "chunk_id"])
    rest = met.join(candidates.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    unit = F.col("best") * DEFINITION_FACTOR * F.when(symbolic, 1.0).otherwise(EMBEDDED_SHARE)
    gained = rest.withColumn("score", definition_gain(F.col("content"), stem, F.col("names"), unit))
    return gained.where("score > 0").drop("names", "best")


def penalize_paths(candidates: DataFrame) -> DataFrame:
    """Scores times the factors of their paths."""
    return candidates.withColumn("score", F.col("score") * path_penalty("file_path"))


def saturate_files(candidates: DataFrame) -> DataFrame:
    """The n-th chunk of a file counts half as much as it would one place earlier."""
    order = W.partitionBy(*_FILE).orderBy(F.desc(F.round("score", SCORE_PLACES)), "chunk_id")
    decay = F.pow(F.lit(SATURATION_DECAY), F.row_number().over(order) - 1)
    return candidates.withColumn("decay", decay).withColumn("score", F.col("score") * F.col("decay")).drop("decay")


def merge_repos(candidates: DataFrame, top_k: int) -> DataFrame:
    """The best rows of each query over all repositories, with their rank."""
    rounded = candidates.withColumn("score", F.round("score", SCORE_PLACES))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return rounded.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def rank_candidates(candidates: DataFrame, top_k: int, query_boosts: bool = True, all_chunks: DataFrame | None = None) -> DataFrame:
    """The whole ranking. Without ``query_boosts`` (find-related) only path penalties and saturation apply.

    ``all_chunks`` (with the candidates' columns) adds chunks that define a queried symbol without being candidates.
    """
    if query_boosts:
        coherent = coherence_boost(candidates)
        candidates = query_boost(coherent)
        if all_chunks is not None:
            candidates = candidates.unionByName(outside_definitions(coherent, all_chunks), allowMissingColumns=True)
    return merge_repos(saturate_files(penalize_paths(candidates)), top_k)
