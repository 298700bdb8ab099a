"""BM25 top-k that scores only what can reach the k best.

Postings carry their whole weight and lie in blocks of a token and a span, each with its greatest weight. Spans are classes of length (about
half an octave), since a token weighs alike in chunks of like length: bounds of a span are much closer than those of all chunks. Within a span, a
hash of the chunk says which block of a token holds it, so a token in a third of all chunks is as many blocks as it needs. A search has two passes.
The first scores the k most promising chunks of the tokens' heads (their greatest weights) in full; the least of those scores is a threshold that
the k-th best reaches. In the second, tokens whose greatest weights in a span together stay below the threshold can't make a chunk one of the best by
themselves: candidates come from the span's other tokens alone, without blocks whose bound stays below, and the tokens left out are looked up in
the candidates' blocks. All results are exact, equal scores included.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bm25 import SCORE_PLACES, query_tokens, top, weighted

#: Postings in a block, about, and in a token's head.
BLOCK, HEAD = 128, 64
#: Sums of the same weights in another order differ by far less.
MARGIN = 1e-6

_KEY = ["query_id", "chunk_id", "repo_id", "span"]
_BLOCK = ["token", "span", "slot"]


def weights(posted: DataFrame, stats: DataFrame) -> DataFrame:
    """(token, chunk_id, repo_id, span, weight) of all postings; store it before ``PrunedIndex.of``, which reads it several times."""
    span = F.floor(2 * F.log2(F.col("dl") + F.lit(1.0))).cast("int").alias("span")
    df = posted.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return weighted(posted, df, stats).select("token", "chunk_id", "repo_id", span, "weight")


def _slot(df: Column, block: int) -> Column:
    return F.pmod(F.xxhash64("chunk_id"), F.ceil(df / block)).alias("slot")


@dataclass(frozen=True)
class PrunedIndex:
    """Three tables to be stored: ``blocks`` (token, span, slot, most, entries), ``terms`` (token, span, df, most) and ``heads`` (token, span, chunk_id, repo_id, weight)."""

    blocks: DataFrame
    terms: DataFrame
    heads: DataFrame
    block: int = BLOCK

    @staticmethod
    def of(weights: DataFrame, block: int = BLOCK, head: int = HEAD) -> PrunedIndex:
        """The tables as plans. A block is one group of about ``block`` rows; heads are cut in each task before they meet."""
        terms = weights.groupBy("token", "span").agg(F.count(F.lit(1)).alias("df"), F.max("weight").alias("most"))
        placed = weights.join(terms.select("token", "span", "df"), ["token", "span"])
        blocks = placed.groupBy("token", "span", _slot(F.col("df"), block)).agg(
            F.max("weight").alias("most"), F.collect_list(F.struct("chunk_id", "repo_id", "weight")).alias("entries")
        )
        order = W.partitionBy("token").orderBy(F.desc("weight"), "chunk_id")
        heads = weights.withColumn("k", F.row_number().over(order)).where(F.col("k") <= head).drop("k")
        return PrunedIndex(blocks, terms, heads, block)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, chunk_id, repo_id, score, rank): the k best positive scores of each query (query_id, query), as ``bm25.top`` has them."""
        asked = self._bounded(queries, k)
        candidates = self._candidates(asked)
        common = self._held(candidates, asked.where("NOT leads"))
        gains = candidates.select(*_KEY, "gain").unionByName(common)
        return top(gains.groupBy(*_KEY).agg(F.round(F.sum("gain"), SCORE_PLACES).alias("score")).drop("span"), k)

    def work(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, postings, read): the postings of a query's tokens, and those in blocks that the second pass opens."""
        asked = self._bounded(queries, k)
        led = self._visited(asked).select("query_id", F.size("entries").alias("read"))
        keys = self._keys(self._candidates(asked), asked.where("NOT leads")).select("query_id", *_BLOCK).distinct()
        looked = keys.join(self.blocks, _BLOCK).select("query_id", F.size("entries").alias("read"))
        opened = led.unionByName(looked).groupBy("query_id").agg(F.sum("read").alias("read"))
        return asked.groupBy("query_id").agg(F.sum("df").alias("postings")).join(opened, "query_id")

    def _keys(self, pairs: DataFrame, asked: DataFrame) -> DataFrame:
        """Where the weights of the asked tokens in the pairs (query_id, chunk_id, repo_id, span) are."""
        both = pairs.select(*_KEY).join(asked.select("query_id", "span", "token", "qtf", "df"), ["query_id", "span"])
        return both.select(*_KEY, "token", "qtf", _slot(F.col("df"), self.block))

    def _held(self, pairs: DataFrame, asked: DataFrame) -> DataFrame:
        """(query_id, chunk_id, repo_id, span, gain) of the asked tokens that the pairs' chunks hold; other blocks are not opened."""
        keys = self._keys(pairs, asked)
        opened = self.blocks.join(keys.select(*_BLOCK).distinct(), _BLOCK, "left_semi")
        entries = opened.select("token", F.explode("entries").alias("e")).select("token", "e.chunk_id", "e.weight")
        return keys.join(entries, ["token", "chunk_id"]).select(*_KEY, (F.col("qtf") * F.col("weight")).alias("gain"))

    def _bounded(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, span, token, qtf, df, most, floor, others, rest, leads): what each token can add in a span, against the threshold ``floor``.

        ``others``: the most that all other tokens add there; ``rest``: the most that the tokens without ``leads`` add, below the floor together.
        """
        asked = query_tokens(queries).join(self.terms, "token").withColumn("most", F.col("qtf") * F.col("most"))
        promising = asked.join(self.heads, ["token", "span"]).groupBy(*_KEY).agg(F.sum(F.col("qtf") * F.col("weight")).alias("score"))
        full = self._held(top(promising, k), asked).groupBy(*_KEY).agg(F.sum("gain").alias("score"))
        enough = F.when(F.count(F.lit(1)) >= k, F.min("score") - MARGIN)
        floors = full.groupBy("query_id").agg(enough.alias("floor"))
        rising = W.partitionBy("query_id", "span").orderBy("most", "token")
        every = W.partitionBy("query_id", "span")
        known = asked.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
        summed = known.withColumns(
            {
                "leads": F.sum("most").over(rising.rowsBetween(W.unboundedPreceding, W.currentRow)) >= F.col("floor"),
                "others": F.sum("most").over(every) - F.col("most"),
            }
        )
        return summed.withColumn("rest", F.sum(F.when(F.col("leads"), 0.0).otherwise(F.col("most"))).over(every))

    def _visited(self, asked: DataFrame) -> DataFrame:
        """Blocks of leading tokens that can hold one of the best."""
        leading = asked.where("leads").select("query_id", "token", "span", "qtf", "floor", "others", "rest")
        return self.blocks.join(leading, ["token", "span"]).where("qtf * most + others >= floor")

    def _candidates(self, asked: DataFrame) -> DataFrame:
        """(query_id, chunk_id, repo_id, span, gain): chunks of visited blocks that reach the floor if they hold all tokens that don't lead."""
        entries = self._visited(asked).select("query_id", "span", "qtf", "floor", "others", "rest", F.explode("entries").alias("e")).where("qtf * e.weight + others >= floor")
        gains = entries.select("query_id", "span", "e.chunk_id", "e.repo_id", "floor", "rest", (F.col("qtf") * F.col("e.weight")).alias("gain"))
        summed = gains.groupBy(*_KEY).agg(F.sum("gain").alias("gain"), F.max("floor").alias("floor"), F.max("rest").alias("rest"))
        return summed.where("gain + rest >= floor").select(*_KEY, "gain")
