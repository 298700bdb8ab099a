"""Evaluation of rankings: NDCG, recall by token budget, cost to the first hit, latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_hit_rank(hits: DataFrame) -> DataFrame:
    """(query_id, target_id, rank) of the first result that covers each target."""
    return hits.groupBy("query_id", "target_id").agg(F.min("rank").alias("rank"))


def ndcg(hits: DataFrame, totals: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ndcg) with gains of one at the first ranks of the targets; ``totals``: (query_id, n_relevant).

    Targets that are first hit at one rank count once. A query without targets or hits has 0.
    """
    gains = (
        first_hit_rank(hits)
        .where(F.col("rank") <= k)
        .select("query_id", "rank")
        .distinct()
        .groupBy("query_id")
        .agg(F.sum(1.0 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    )
    places = F.when(F.col("n_relevant") > 0, F.sequence(F.lit(1), F.least(F.col("n_relevant").cast("int"), F.lit(k)))).otherwise(
        F.array().cast("array<int>")
    )
    ideal = F.aggregate(places, F.lit(0.0), lambda s, r: s + 1.0 / F.log2(r + 1.0))
    scored = totals.withColumn("ideal", ideal).join(gains, "query_id", "left")
    return scored.select(
        "query_id", F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(F.lit(0.0)).alias("ndcg")
    )


def curves(units: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, rank, tokens, covered): tokens read and targets covered after each unit (query_id, rank, n_tokens)."""
    new = first_hit_rank(hits).groupBy("query_id", "rank").agg(F.count(F.lit(1)).alias("new"))
    running = W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    joined = units.join(new, ["query_id", "rank"], "left")
    return joined.select(
        "query_id",
        "rank",
        F.sum("n_tokens").over(running).alias("tokens"),
        F.coalesce(F.sum("new").over(running), F.lit(0)).alias("covered"),
    )


def recall_at_budget(curve: DataFrame, totals: DataFrame, budgets: list[int]) -> DataFrame:
    """(query_id, budget, recall) from the targets covered at the last point within each budget."""
    wanted = totals.withColumn("budget", F.explode(F.array(*[F.lit(b).cast("long") for b in budgets])))
    joined = wanted.join(curve, "query_id", "left")
    within = F.max(F.when(F.col("tokens") <= F.col("budget"), F.col("covered")))
    return joined.groupBy("query_id", "budget", "n_relevant").agg(F.coalesce(within, F.lit(0)).alias("n")).select(
        "query_id", "budget", F.when(F.col("n_relevant") > 0, F.col("n") / F.col("n_relevant")).otherwise(F.lit(0.0)).alias("recall")
    )


def first_hit_tokens(curve: DataFrame) -> DataFrame:
    """(query_id, tokens) read when the first target was covered."""
    return curve.where("covered > 0").groupBy("query_id").agg(F.min("tokens").alias("tokens"))


def expected_cost(curve: DataFrame, totals: DataFrame, cap: int) -> DataFrame:
    """One row (cost): mean tokens to the first hit, the cap where there is none; hits beyond the cap are not capped."""
    asked = totals.where("n_relevant > 0").select("query_id")
    cost = F.coalesce(F.col("tokens"), F.lit(cap)).cast("double")
    return asked.join(first_hit_tokens(curve), "query_id", "left").agg(F.coalesce(F.avg(cost), F.lit(float(cap))).alias("cost"))


def paired_reduction(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """One row comparing two methods' tokens to the first hit on the queries where both hit."""
    pairs = ours.select("query_id", F.col("tokens").alias("a")).join(theirs.select("query_id", F.col("tokens").alias("b")), "query_id").where("b > 0")
    ratio = F.col("a") / F.col("b")
    return pairs.agg(
        F.count(F.lit(1)).alias("n_paired"),
        F.median("a").alias("median_ours"),
        F.median("b").alias("median_theirs"),
        (1.0 - F.median(ratio)).alias("median_reduction"),
        (1.0 - F.avg(ratio)).alias("mean_reduction"),
        F.avg((F.col("a") < F.col("b")).cast("double")).alias("share_better"),
    )


def latency_percentiles(latencies: DataFrame, column: str, by: list[str]) -> DataFrame:
    """p50, p90, p95 and p99 with linear interpolation."""
    percents = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    return latencies.groupBy(*by).agg(*[F.percentile(column, F.lit(p)).alias(name) for name, p in percents.items()])


def summary(results: DataFrame, by: list[str], values: list[str], places: int = 4) -> DataFrame:
    """Rounded means by group."""
    return results.groupBy(*by).agg(*[F.round(F.avg(v), places).alias(f"avg_{v}") for v in values])


def keyword_files(files: DataFrame, keywords: DataFrame, most_matches: int = 500) -> DataFrame:
    """(query_id, file_path, hits, rank): files by the number of lines that hold keywords, ignoring case.

    ``files``: file_path, content; ``keywords``: query_id, keyword, a stated set. A line is searched once for all keywords together: they are an array that goes
    to the lines as one row, and lines without any go no further. Of each keyword the first ``most_matches`` lines (by path and line) count, as
    the compared tool's limit has it.
    """
    words = keywords.select("query_id", F.lower("keyword").alias("keyword")).distinct()
    every = words.agg(F.collect_set("keyword").alias("every"))
    lines = files.select("file_path", F.posexplode(F.split(F.lower("content"), "\n")).alias("line", "text")).crossJoin(F.broadcast(every))  # one row
    held = lines.select("file_path", "line", F.explode(F.filter("every", lambda w: F.contains(F.col("text"), w))).alias("keyword"))
    hit = held.join(words, "keyword")
    order = W.partitionBy("query_id", "keyword").orderBy("file_path", "line")
    first = hit.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most_matches)
    counted = first.groupBy("query_id", "file_path").agg(F.count(F.lit(1)).alias("hits"))
    ranked = W.partitionBy("query_id").orderBy(F.desc("hits"), "file_path")
    return counted.withColumn("rank", F.row_number().over(ranked))


def pattern_files(files: DataFrame, pattern: str, ignore_case: bool = True) -> DataFrame:
    """(file_path, hits): the number of lines that one pattern matches, in each file with any; the pattern is a regular expression."""
    wanted = F.lit(("(?i)" if ignore_case else "") + pattern)
    matching = F.filter(F.split("content", "\n"), lambda line: F.rlike(line, wanted))
    return files.select("file_path", F.size(matching).cast("long").alias("hits")).where("hits > 0")


def rollup(results: DataFrame, values: list[str], places: int = 4) -> DataFrame:
    """Means over repositories: of everything, by language, and by category, with what each row is about.

    ``results``: one row per repository, language and category. A repository counts once in each mean.
    """
    per_repo = results.groupBy("repo", "language").agg(*[F.avg(v).alias(v) for v in values])
    means = [F.round(F.avg(v), places).alias(v) for v in values]
    every = per_repo.groupBy(F.lit("all").alias("level"), F.lit("").alias("name")).agg(*means)
    by_language = per_repo.groupBy(F.lit("language").alias("level"), F.col("language").alias("name")).agg(*means)
    by_category = results.groupBy(F.lit("category").alias("level"), F.col("category").alias("name")).agg(*means)
    return every.unionByName(by_language).unionByName(by_category)
