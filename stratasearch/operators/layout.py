"""Tables laid out by buckets of repositories, so that a search in a few repositories reads only their buckets.

Rows are written into ``buckets`` folders by a hash of the repository. Where the scopes of a batch of queries are known only when it runs, the
table is joined with the buckets that they name; there are no more of those than folders, so that side is broadcast, and Spark prunes the folders
by it before anything is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 64
BUCKET = "bucket"


def bucket_of(repo: Column, buckets: int = BUCKETS) -> Column:
    """The folder of a repository; null has one too."""
    return F.pmod(F.xxhash64(repo.cast("string")), F.lit(buckets)).cast("int")


def write_by_repository(rows: DataFrame, path: str, repo: str, buckets: int = BUCKETS, mode: str = "errorifexists") -> None:
    """Write ``rows`` with a folder for each bucket of ``repo``. The rows of a bucket are gathered, but a large one is split over several tasks and files."""
    dealt = rows.withColumn(BUCKET, bucket_of(F.col(repo), buckets)).hint("rebalance", BUCKET)
    dealt.write.mode(mode).partitionBy(BUCKET).parquet(path)


def in_scopes(rows: DataFrame, scopes: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows (with ``bucket``) of the buckets that ``scopes`` (scope) names; a null scope names all. Other repositories of a bucket come along."""
    every = F.sequence(F.lit(0), F.lit(buckets - 1))
    named = F.when(F.col("scope").isNull(), every).otherwise(F.array(bucket_of(F.col("scope"), buckets)))
    wanted = scopes.select("scope").distinct().select(F.explode(named).alias(BUCKET)).where(F.col(BUCKET) >= 0).distinct()
    return rows.join(F.broadcast(wanted), BUCKET, "left_semi")  # at most ``buckets`` rows
