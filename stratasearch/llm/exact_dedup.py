"""Exact dedup by a heavy-hitter split.

1. Every text becomes a digest (sha-256 of the text with A-Z lower-cased). Only (doc_id, digest) goes on.
2. A Misra-Gries summary (the frequent-items sketch behind ``approx_top_k``; counters that are purged
   together, merged from all partitions in two levels) names the digests that may be frequent. It has a
   fixed number of counters, and every digest with more than a share of about 1 / counters of the rows is among them.
3. Those candidates are counted exactly; their size, and hence the broadcast, is bounded by the number of counters.
   The verified winners are broadcast and their rows are decided where they are, without a shuffle.
4. What is left has no frequent digest and goes through an ordinary shuffle by digest: counted with a map-side combination, so
   no task gathers the rows of a digest, and joined back.

Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, unused_name, without_rows

#: Rows of a list of dropped rows that is broadcast (about 100 bytes each); a longer one is shuffled.
MOST_BROADCAST = 250_000


def digest_of(text: Column | str) -> Column:
    """sha-256 of a text with A-Z lower-cased, as 32 bytes; a null text counts as empty."""
    return F.unhex(F.sha2(ascii_lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), 256))


def digests(documents: DataFrame) -> DataFrame:
    """(doc_id, digest binary) of every row; a null text counts as empty."""
    return documents.select("doc_id", digest_of("text").alias("digest"))


def frequent_digests(keyed: DataFrame, counters: int = 1024, spread: int = 32) -> DataFrame:
    """At most ``counters`` candidate digests: a Misra-Gries summary over all rows, merged in two levels."""
    name = F.hex("digest").alias("name")
    first = (
        keyed.select(name, F.pmod(F.spark_partition_id(), F.lit(spread)).alias("part"))
        .groupBy("part")
        .agg(F.expr(f"approx_top_k_accumulate(name, {counters})").alias("sketch"))
    )
    # grouped, as a combination without groups fails on partitions without rows
    merged = first.groupBy((F.col("part") % 1).alias("all")).agg(
        F.expr(f"approx_top_k_combine(sketch, {counters})").alias("sketch")
    )
    return merged.select(
        F.explode(F.expr(f"approx_top_k_estimate(sketch, {counters // 2})")).alias("top")
    ).select(F.unhex("top.item").alias("digest"))


def _groups(keyed: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size)."""
    return keyed.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def frequent_groups(keyed: DataFrame, counters: int, least_copies: int) -> DataFrame:
    """(digest, keep_id, group_size) of the verified winners, ``counters`` rows at most."""
    candidates = keyed.join(F.broadcast(frequent_digests(keyed, counters)), "digest")
    return materialize(_groups(candidates).where(F.col("group_size") >= least_copies))


def mark_copies(documents: DataFrame, counters: int = 1024, least_copies: int = 16) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; the row with the largest doc_id stays.
    ``counters`` bounds the summary and the broadcast; a candidate with at least ``least_copies`` rows is a winner.

    Null and empty texts are equal to each other. A null doc_id is smaller than any other; a group with
    null ids only keeps them all (keep_id null). Rows that repeat the id that stays are all marked as kept:
    doc_id is taken for a key. An empty table gives an empty result. Other columns are ignored.
    """
    keyed = materialize(digests(documents))
    winners = F.broadcast(frequent_groups(keyed, counters, least_copies))
    hot = keyed.join(winners, "digest").select("doc_id", "digest", "keep_id", "group_size")
    rest = keyed.join(winners, "digest", "left_anti")
    cold = rest.join(_groups(rest), "digest").select("doc_id", "digest", "keep_id", "group_size")
    return hot.unionByName(cold).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(documents: DataFrame, counters: int = 1024, least_copies: int = 16) -> DataFrame:
    """The rows of ``documents`` that stay, with all their columns. See ``mark_copies``; rows with a null doc_id stay.

    Decided by (doc_id, digest): where an id repeats with different texts, a dropped copy takes no other text with it, and of
    rows that repeat id and text one stays. Copies of frequent digests are removed where they are read. The list of the other dropped rows
    is broadcast up to MOST_BROADCAST rows; then no text is shuffled.
    """
    keyed = materialize(digests(documents).where("doc_id IS NOT NULL"))
    winners = frequent_groups(keyed, counters, least_copies)
    rest = keyed.join(F.broadcast(winners), "digest", "left_anti")
    dropped = rest.join(_groups(rest), "digest").where("doc_id <> keep_id").select("doc_id", "digest").distinct()
    repeated = keyed.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "digest")

    digest, keep = unused_name(documents.columns, "digest"), unused_name(documents.columns, "keep_id")
    named = F.broadcast(winners.select(F.col("digest").alias(digest), F.col("keep_id").alias(keep)))
    there = documents.withColumn(digest, digest_of("text")).join(named, digest, "left")
    there = there.where(F.col(keep).isNull() | F.col("doc_id").isNull() | (F.col("doc_id") == F.col(keep)))
    return without_rows(there, F.col(digest), "digest", dropped, repeated, MOST_BROADCAST).select(*documents.columns)
