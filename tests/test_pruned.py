"""Pruned BM25 gives what scoring everything gives, and opens few of the postings where weights differ."""

import random

import pytest
from pyspark.sql import functions as F

from stratasearch.operators import bm25
from stratasearch.operators.pruned import PrunedIndex, weights


def corpus(spark, n=3000, seed=3):
    """Texts whose words follow a power law; some come twice, so scores tie."""
    draw = random.Random(seed)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in range(4000)]
    share = [1 / (k + 1) for k in range(len(words))]
    texts = [draw.choices(words, share, k=draw.randint(5, 60)) for _ in range(n)]
    texts += texts[:40] + [[], [words[0]] * 50]
    rows = [(f"c{k:05}", f"r{k % 3}", text) for k, text in enumerate(texts)]
    return spark.createDataFrame(rows, "chunk_id string, repo_id string, tokens array<string>"), texts, words


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pruned")
    tokens, texts, words = corpus(spark)
    posted, stats = bm25.postings(tokens), bm25.doc_stats(tokens)

    def stored(name, df):
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    posted, stats = stored("postings", posted), stored("stats", stats)
    plan = PrunedIndex.of(stored("weights", weights(posted, stats)), block=32, head=16)
    index = PrunedIndex(stored("blocks", plan.blocks), stored("terms", plan.terms), stored("heads", plan.heads), 32)
    asked = [" ".join(texts[k][:6]) for k in range(0, 60, 3)] + [words[0], " ".join(words[:8]), f"{words[3900]} {words[0]} {words[0]}", "nowhere", "", None]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    return posted, stats, index, queries


def rows(found):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], r["repo_id"], round(r["score"], 8)) for r in found.collect())


@pytest.mark.parametrize("k", [1, 10, 5000])
def test_as_scoring_everything(built, k):
    posted, stats, index, queries = built
    assert rows(index.search(queries, k)) == rows(bm25.top(bm25.scores(queries, posted, stats), k))


def share_read(index, queries, k):
    read, postings = index.work(queries, k).agg(F.sum("read"), F.sum("postings")).first()
    return read / postings


def test_few_postings_are_read_where_enough_chunks_match_well(spark, built):
    _, _, index, queries = built
    _, _, words = corpus(spark, n=1)
    rare = spark.createDataFrame([(k, f"{words[150 + k]} {words[0]} {words[1]}") for k in range(20)], "query_id long, query string")
    assert 0 < share_read(index, rare, 5) < 0.5
    # with fewer good matches than k the threshold is low, and most blocks are opened
    assert 0 < share_read(index, queries.where("query_id < 20"), 5) <= 1


def test_blocks_are_bounded_and_whole(built):
    posted, _, index, _ = built
    sizes = index.blocks.agg(F.max(F.size("entries")), F.sum(F.size("entries"))).first()
    assert sizes[0] <= 3 * 32 and sizes[1] == posted.count()


def test_nothing_stored_or_asked(spark, built):
    _, _, index, queries = built
    assert index.search(queries.limit(0), 5).collect() == []
    empty = spark.createDataFrame([], "chunk_id string, repo_id string, tokens array<string>")
    nothing = PrunedIndex.of(weights(bm25.postings(empty), bm25.doc_stats(empty)))
    assert nothing.search(queries, 5).collect() == []
