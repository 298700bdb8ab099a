"""The incremental index over growing input, against an index built at once."""

import os
import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from jobs import index_documents as job
from stratasearch.functions import plain
from stratasearch.operators import bm25

SCHEMA = "doc_id long, source string, lang string, text string, extra int"
FIRST = [(1, "s1", "en", "alpha beta\ngamma", 0), (2, "s1", "de", "beta Beta", 0), (3, "s2", "en", "", 0), (4, "s2", None, None, 0), (None, "s", "en", "lost", 0)]
SECOND = [(2, "s1", "de", "delta only", 9), (5, "s3", "en", "epsilon", 0), (1, "s1", "en", "alpha beta\ngamma", 1), (5, "s3", "en", "epsilon", 0), (3, "s2", "en", "now there", 0)]


@pytest.fixture
def places(tmp_path):
    return tuple(str(tmp_path / name) for name in ("in", "out", "state"))


def add(spark, source, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def state(spark, target):
    chunks = job.current(spark, target).select("doc_id", "chunk_id", "content", "n_tokens", "n_terms")
    postings = job.current(spark, target, "postings").select("token", "chunk_id", "doc_id", "tf")
    documents = job.current(spark, target, "documents").select("doc_id", "digest")
    return [rows_of(x) for x in (chunks, postings, documents)]


def test_two_runs_equal_one(spark, places, tmp_path):
    source, target, checkpoint = places
    add(spark, source, FIRST)
    assert job.run(spark, source, target, checkpoint) == 5
    assert [r[2] for r in state(spark, target)[0]] == ["alpha beta\ngamma", "beta Beta"]
    add(spark, source, SECOND)
    assert job.run(spark, source, target, checkpoint) == 5
    after = state(spark, target)
    assert job.run(spark, source, target, checkpoint) == 0
    assert state(spark, target) == after
    assert [r[:1] + r[2:3] for r in after[0]] == [(1, "alpha beta\ngamma"), (2, "delta only"), (3, "now there"), (5, "epsilon")]
    assert not {t for t, _, d, _ in after[1] if d == 2} & {"beta"}
    written = job.stored(spark, target, "documents").where("batch = 1").select("doc_id")
    assert rows_of(written) == [(2,), (3,), (5,)]  # document 1 is as it was

    final = {r[0]: r for r in FIRST + SECOND if r[0] is not None}
    whole, out, kept = (str(tmp_path / name) for name in ("whole", "whole-out", "whole-state"))
    add(spark, whole, list(final.values()))
    job.run(spark, whole, out, kept)
    assert state(spark, out) == after


def test_a_batch_that_failed_is_run_again(spark, places):
    source, target, checkpoint = places
    add(spark, source, FIRST)
    job.run(spark, source, target, checkpoint)
    add(spark, source, SECOND)
    job.run(spark, source, target, checkpoint)
    after = state(spark, target)
    for name in (f"{checkpoint}/commits/1", f"{checkpoint}/commits/.1.crc"):  # as if the run had ended before it said so
        if os.path.exists(name):
            os.remove(name)
    assert job.run(spark, source, target, checkpoint) == 5
    assert state(spark, target) == after


def test_a_job_that_breaks_leaves_nothing_half_done(spark, places, monkeypatch):
    source, target, checkpoint = places
    add(spark, source, FIRST)
    job.run(spark, source, target, checkpoint)
    add(spark, source, SECOND)
    with monkeypatch.context() as patch:
        patch.setattr(job.bm25, "postings", lambda rows: 1 / 0)
        with pytest.raises(Exception, match="division|ForeachBatch|foreach"):
            job.run(spark, source, target, checkpoint)
    assert job.run(spark, source, target, checkpoint) == 5
    assert [r[0] for r in state(spark, target)[0]] == [1, 2, 3, 5]


def test_files_of_one_batch_and_repeated_ids(spark, places):
    """The newest file counts, whatever the order in which files are listed; of rows of one file, one."""
    source, target, checkpoint = places
    add(spark, source, [(1, "s", "en", "old words", 0), (1, "s", "en", "other words", 0)])
    for k, path in enumerate(Path(source).glob("*.parquet")):
        os.utime(path, (1_000_000 + k, 1_000_000 + k))
    add(spark, source, [(1, "s", "en", "new words", 0)])
    job.run(spark, source, target, checkpoint)
    assert [r[2] for r in state(spark, target)[0]] == ["new words"]


def test_search_over_the_index(spark, places):
    source, target, checkpoint = places
    add(spark, source, FIRST)
    job.run(spark, source, target, checkpoint)
    add(spark, source, SECOND)
    job.run(spark, source, target, checkpoint)
    chunks = job.current(spark, target)
    queries = spark.createDataFrame([(0, "beta delta")], "query_id long, query string")
    lengths = chunks.select("chunk_id", "repo_id", chunks.n_tokens.cast("int").alias("dl"))
    found = bm25.top(bm25.scores(queries, job.current(spark, target, "postings"), lengths), 5)
    assert {r["doc_id"] for r in found.join(chunks, "chunk_id").collect()} == {1, 2}


def test_command_line(spark, places):
    source, target, checkpoint = places
    add(spark, source, FIRST)
    command = [sys.executable, "-m", "jobs.index_documents", source, target, checkpoint]
    done = subprocess.run(command, cwd=Path(job.__file__).parent.parent, capture_output=True, text=True, timeout=180, env=os.environ | {"SPARK_LOCAL_IP": "127.0.0.1"})
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read 5 rows in 1 batches" in done.stderr
    assert len(state(spark, target)[0]) == 2


def test_postings_take_little_room_and_no_text_is_cached(spark, places, monkeypatch):
    """Ids of chunks took 16 bytes and more a posting, and cached texts and chunks went to disk."""
    source, target, checkpoint = places
    words = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda k: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", k), F.lit(500))))
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.array_join(words, " ").alias("text"))
    rows.coalesce(2).write.parquet(source)
    kept, persist = [], type(rows).persist
    monkeypatch.setattr(type(rows), "persist", lambda self, *a: kept.append(self.columns) or persist(self, *a))
    job.run(spark, source, target, checkpoint, {"token_buckets": 1})
    assert kept and not [x for x in kept if {"content", "text", "terms"} & set(x)]
    chunks, found = job.current(spark, target), job.current(spark, target, "postings")
    want = bm25.postings(chunks.select("chunk_id", "repo_id", bm25.index_tokens("content", "file_path").alias("tokens")))
    columns = ("token", "chunk_id", "repo_id", "tf")
    assert found.count() == want.count() > 150_000
    assert found.select(*columns).exceptAll(want.select(*columns)).count() == 0
    room = sum(f.stat().st_size for f in Path(target, "postings").rglob("*.parquet"))
    assert room < 6 * found.count()


@pytest.mark.parametrize("few", [0, 1])
def test_more_changed_ids_than_are_broadcast(spark, places, few, monkeypatch):
    """Few unchanged documents, then many of either kind: the rows are those of small lists."""
    source, target, checkpoint = places
    add(spark, source, FIRST)
    job.run(spark, source, target, checkpoint)
    monkeypatch.setattr(job, "FEW_REPEATED", few)
    add(spark, source, SECOND)
    assert job.run(spark, source, target, checkpoint) == 5
    chunks, _, documents = state(spark, target)
    assert [(r[0], r[2]) for r in chunks] == [(1, "alpha beta\ngamma"), (2, "delta only"), (3, "now there"), (5, "epsilon")] and [r[0] for r in documents] == [1, 2, 3, 4, 5]


def test_lists_over_several_blocks(monkeypatch):
    """Lists of a task, in any order of numbers, over borders of blocks and of what is gathered at once."""
    monkeypatch.setattr(bm25, "LIST_BLOCK", 4)
    monkeypatch.setattr(bm25, "LIST_TOKENS", 9)
    texts = ["a b a", "", "getName a", None, "b b b c", "C9 a", "z_y", "a a a a"] * 2
    numbers = [9, 3, 14, 0, 5, 1, (1 << 33) + 2, 7, 8, 2, 13, 4, 6, 10, (1 << 33) + 3, 11]
    batch = pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(texts)], names=["number", "text"])
    found, seen = {}, 0
    for part in bm25._lists(iter([batch.slice(0, 5), batch.slice(5)])):
        for row in part.to_pylist():
            seen += 1
            assert row["places"] == sorted(row["places"]) and 0 <= min(row["places"]) <= max(row["places"]) < 4
            for place, tf in zip(row["places"], row["tfs"], strict=True):
                key = (row["token"], row["block"] * 4 + place)
                assert key not in found
                found[key] = tf
    want = {}
    for number, text in zip(numbers, texts):
        for token in plain.tokenize(text):
            want[token, number] = want.get((token, number), 0) + 1
    assert found == want and seen < len(found)
