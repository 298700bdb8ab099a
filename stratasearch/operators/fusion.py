"""Reciprocal-rank fusion of dense and sparse results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import is_symbol_query

RRF_K, ALPHA_SYMBOL, ALPHA_WORDS = 60, 0.3, 0.5


def rrf_weights(ranked: DataFrame, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """``ranked`` (with chunk_id and score) and the weight 1 / (60 + rank) of each row."""
    order = W.partitionBy(*by).orderBy(F.desc("score"), "chunk_id")
    return ranked.withColumn("rrf", 1.0 / (RRF_K + F.row_number().over(order)))


def alpha_of(query: Column | str, given: Column | None = None) -> Column:
    """The share of the dense side: the given one, else 0.3 for symbols and 0.5 for words."""
    auto = F.when(is_symbol_query(query), F.lit(ALPHA_SYMBOL)).otherwise(F.lit(ALPHA_WORDS))
    return auto if given is None else F.coalesce(given.cast("double"), auto)


def fuse(dense: DataFrame, sparse: DataFrame, alphas: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score): alpha times the dense weight plus the rest times the sparse one; a missing side is 0.

    ``alphas``: (query_id, alpha). Both sides are cut to the coarse number of rows already.
    """
    key = ["query_id", "chunk_id"]
    left = rrf_weights(dense).select(*key, F.col("rrf").alias("dense"))
    right = rrf_weights(sparse).select(*key, F.col("rrf").alias("sparse"))
    both = left.join(right, key, "full").join(alphas.select("query_id", "alpha"), "query_id")
    zero = F.lit(0.0)
    score = F.col("alpha") * F.coalesce("dense", zero) + (1.0 - F.col("alpha")) * F.coalesce("sparse", zero)
    return both.select(*key, score.alias("score"))
