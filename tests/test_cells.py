"""Cells with bounds give what scoring everything gives, without a shuffle of postings, and leave out chunks that can't be among the best."""

import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from stratasearch.functions.plain import text_blocks
from stratasearch.operators import bm25
from stratasearch.operators import cells as module
from stratasearch.operators.cells import CellIndex, cells
from test_pruned import corpus, rows


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("cells"))
    tokens, texts, words = corpus(spark)
    cells(tokens.repartition(3), 64).write.parquet(f"{folder}/cells")
    asked = [" ".join(texts[k][:6]) for k in range(0, 60, 3)] + [words[0], " ".join(words[:8]), f"{words[3900]} {words[0]} {words[0]}", "nowhere", "", None]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    return tokens.persist(), CellIndex(spark.read.parquet(f"{folder}/cells")), queries, words


@pytest.mark.parametrize("k", [1, 10, 5000])
def test_as_scoring_everything(built, k):
    tokens, index, queries, _ = built
    want = rows(bm25.top(bm25.scores(queries, bm25.postings(tokens), bm25.doc_stats(tokens)), k))
    assert want and rows(index.search(queries, k)) == want
    assert rows(index.search(queries, k, most_cells=300)) == want  # in several parts


def test_cells_are_bounded_and_whole(built):
    tokens, index, _, _ = built
    sizes = index.cells.agg(F.max("n"), F.sum("n"), F.sum("total"), F.sum(F.size("tfs")), F.count_distinct("cell"), F.count(F.lit(1))).first()
    assert sizes[0] <= 64 and sizes[1] == tokens.count() and sizes[2] == tokens.agg(F.sum(F.size("tokens"))).first()[0]
    assert sizes[3] == bm25.postings(tokens).count() and sizes[4] == sizes[5]


def test_chunks_below_the_threshold_are_not_scored(spark, built):
    _, index, _, words = built
    rare = spark.createDataFrame([(k, f"{words[150 + k]} {words[0]} {words[1]}") for k in range(20)], "query_id long, query string")
    held, scored = index.work(rare, 5).agg(F.sum("held"), F.sum("scored")).first()
    assert 0 < scored < held / 2


def test_nothing_stored_or_asked(spark, built):
    tokens, index, queries, _ = built
    assert index.search(queries.limit(0), 5).collect() == []
    assert CellIndex(cells(tokens.limit(0))).search(queries, 5).collect() == []


def test_the_query_moves_no_postings(spark, data):
    """The registered query's plan has one exchange, of the best rows of each task."""
    plan = entry.queries()["bm25_pruned_topk"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_texts_stand_for_tokens(spark, built, monkeypatch):
    """Texts cut in the tasks give the cells' rows that arrays of tokens give, also where a block of weights holds less than a cell."""
    _, _, queries, _ = built
    texts = ["getUserName one_two Two", "", None, "two two three", "x" * 50, "get user 9lives"] * 40
    whole = spark.createDataFrame([(f"c{k:03}", f"r{k % 3}", f"d/f{k}.py", x) for k, x in enumerate(texts)], "chunk_id string, repo_id string, file_path string, content string")
    asked = queries.limit(0).union(spark.createDataFrame([(0, "user two"), (1, "three two f7"), (2, "getUserName d")], queries.schema))
    want = rows(bm25.best_in(asked, bm25.tokenized(whole), 5))
    assert want and rows(CellIndex(cells(bm25.texts_of(whole), 64)).search(asked, 5)) == want
    monkeypatch.setattr(module, "MOST_CELLS", 30)  # a few chunks at once, of 64
    assert rows(CellIndex(cells(bm25.texts_of(whole), 64)).search(asked, 5, most_cells=1 << 20)) == want


def test_a_stored_file_holds_few_cells(spark, built, tmp_path):
    """The reader decodes a file of up to 100 rows at once, so files are bounded, whatever a task writes."""
    tokens, index, queries, _ = built
    made = CellIndex.build(tokens.coalesce(1), str(tmp_path / "cells"), 16)
    files = made.cells.groupBy("_metadata.file_path").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("chunks")).collect()
    assert sum(r["chunks"] for r in files) == tokens.count() and len(files) > 1 and max(r["n"] for r in files) <= module.FILE_CELLS
    assert rows(made.search(queries, 10)) == rows(index.search(queries, 10))


def test_an_index_for_one_batch(spark, built, tmp_path, monkeypatch):
    """It has the postings of the batch's tokens only, gives what the whole index gives, and says so when it is asked for others."""
    tokens, index, queries, words = built
    some = queries.where("query_id < 5 OR query_id > 20")
    made = CellIndex.build(tokens, str(tmp_path / "some"), 64, queries=some)
    assert rows(made.search(some, 10)) == rows(index.search(some, 10))
    held = {r[0] for r in made.cells.select(F.explode("tokens")).distinct().collect()}
    assert held == {r[0] for r in bm25.query_tokens(some).select("token").distinct().collect()} & {r[0] for r in index.cells.select(F.explode("tokens")).distinct().collect()}
    with pytest.raises(ValueError, match="other queries"):
        made.search(spark.createDataFrame([(1, "elsewhere")], queries.schema), 10)
    monkeypatch.setattr(module, "MOST_WORDS", 3)
    whole = CellIndex.build(tokens, str(tmp_path / "whole"), 64, queries=some)
    assert whole.words is None and rows(whole.search(queries, 10)) == rows(index.search(queries, 10))


def test_a_task_holds_a_block_of_texts_not_a_batch():
    """Cutting takes memory by the block: a batch of many texts needs hardly more than its tokens' places."""
    text = " ".join(f"word{k % 5000}" for k in range(600))
    n = 6000
    batch = pa.RecordBatch.from_arrays([pa.array([str(k) for k in range(n)]), pa.array(["r"] * n), pa.array([text] * n)], names=["chunk_id", "repo_id", "text"])
    parts = list(text_blocks(batch, 2, 1 << 20))
    assert [len(x) for x in parts[:-1]] == [(1 << 20) // len(text)] * (len(parts) - 1) and pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert [len(x) for x in text_blocks(batch, 2, 10)][:3] == [1, 1, 1]
    tracemalloc.start()
    try:
        found = [sum(len(lists[0]) for lists in module._cells_of(iter([batch]), 1024, cut=True))]
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == [n] and most < 8 * batch.nbytes, (most, batch.nbytes)
