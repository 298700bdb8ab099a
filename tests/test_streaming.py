"""Files that appear become chunks, once each."""

from datetime import datetime

from stratasearch.streaming import ingest


def test_ingestion(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))
    now = datetime(2024, 1, 1)

    def drop(*rows):
        spark.createDataFrame([(*r, now) for r in rows], ingest.FILES).coalesce(1).write.mode("append").parquet(source)

    drop(("r", "a.py", "python", "alpha = 1\n"), ("r", "b.py", "python", "beta = 2\n"))
    ingest.start_ingestion(spark, source, target, checkpoint).awaitTermination()
    drop(("r", "a.py", "python", "alpha = 1\n"), ("r", "c.py", "python", "gamma = 3\n"), ("r", "n.py", "python", "a\x00"))
    ingest.start_ingestion(spark, source, target, checkpoint).awaitTermination()
    chunks = ingest.ingested(spark, target, "chunks")
    assert sorted(r["file_path"] for r in chunks.collect()) == ["a.py", "b.py", "c.py"]
    assert ingest.ingested(spark, target, "doc_stats").count() == 3
    assert "gamma" in {r["token"] for r in ingest.ingested(spark, target, "postings").collect()}


def live(spark, target):
    return sorted(r["content"] for r in ingest.ingested(spark, target, "chunks").collect())


def test_changed_and_deleted_files_are_replaced(spark, tmp_path):
    """Three batches with a change, a deletion, a return and a batch that is run again; each run is a restart."""
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))

    def step(hour, *rows):
        spark.createDataFrame([("r", path, "python", text, datetime(2024, 1, 1, hour)) for path, text in rows], ingest.FILES).coalesce(1).write.mode("append").parquet(source)
        ingest.start_ingestion(spark, source, target, checkpoint).awaitTermination()

    step(1, ("a.py", "x = 1\n"), ("b.py", "beta = 2\n"), ("c.py", "gone = 3\n"))
    step(2, ("a.py", "y = 2\n"), ("c.py", None))
    assert live(spark, target) == ["beta = 2\n", "y = 2\n"]
    tokens = {r["token"] for r in ingest.ingested(spark, target, "postings").collect()}
    assert "y" in tokens and not tokens & {"x", "gone"}
    assert ingest.ingested(spark, target, "doc_stats").count() == 2
    step(3, ("a.py", "x = 1\n"), ("c.py", "back = 3\n"), ("c.py", "never seen\n"), ("b.py", "beta = 2\n"))
    last = live(spark, target)
    assert len(last) == 3 and {"x = 1\n", "beta = 2\n"} < set(last) and set(last) & {"back = 3\n", "never seen\n"}  # one state of c.py
    for name in ("commits/2", "commits/.2.crc"):  # as if the last batch had not been acknowledged
        (tmp_path / "state" / name).unlink(missing_ok=True)
    ingest.start_ingestion(spark, source, target, checkpoint).awaitTermination()
    assert live(spark, target) == last


def test_states_of_one_batch(spark):
    rows = [("r", "a", "x", "old", datetime(2024, 1, 1)), ("r", "a", "x", "new", datetime(2024, 1, 2)), ("r", "b", "x", "here", datetime(2024, 1, 1)), ("r", "b", "x", None, datetime(2024, 1, 3)), (None, "a", "x", "other", None)]
    got = {(r["repo_id"], r["file_path"]): r["content"] for r in ingest.newest_states(spark.createDataFrame(rows, ingest.FILES)).collect()}
    assert got == {("r", "a"): "new", ("r", "b"): None, (None, "a"): "other"}


def test_windowed_counts_on_a_stream(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    table = {tuple(r) for r in ingest.windowed_counts(events).select("window_start", "event_type", "n").collect()}
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    query = ingest.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counted").start()
    query.processAllAvailable()
    query.stop()
    assert {tuple(r) for r in spark.sql("SELECT window_start, event_type, n FROM counted").collect()} == table
