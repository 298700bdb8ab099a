"""Continuous ingestion: files that appear in a directory become searchable chunks; a file that comes again replaces its former self.

A row of the stream is a state of a file: its content, or null where the file is gone. Each batch keeps the newest state of a file, writes chunks, postings and
statistics into folders of its own, and lists the chunks of earlier batches that no longer count. Readers leave those out, so nothing is rewritten and what
they join is as long as the list of changes. A batch that is run again after a failure overwrites its folders with the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import bm25
from ..operators.chunking import line_chunks, with_chunk_ids
from ..operators.filters import readable_files

FILES = T.StructType(
    [
        T.StructField("repo_id", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("seen_at", T.TimestampType()),
    ]
)


REPLACED = "chunk_id string, old_batch int, batch int"


def newest_states(files: DataFrame) -> DataFrame:
    """One row per file (repo_id, file_path): the one seen last; of equal times, that with the greater hash."""
    state = F.struct("seen_at", F.xxhash64("language", "content").alias("hash"), "language", "content")
    return files.groupBy("repo_id", "file_path").agg(F.max(state).alias("s")).select("repo_id", "file_path", "s.language", "s.content", "s.seen_at")


def write_batch(files: DataFrame, number: int, target: str) -> None:
    """Keep the states of some files as batch ``number``; what earlier batches hold of the same files is listed as replaced."""
    spark = files.sparkSession
    newest = newest_states(files).persist()
    chunks = with_chunk_ids(line_chunks(readable_files(newest))).dropDuplicates(["chunk_id"]).persist()
    tokens = bm25.tokenized(chunks).persist()
    try:
        gone = spark.createDataFrame([], REPLACED).drop("batch")
        if number:
            known = ingested(spark, target, "chunks", before=number, with_batch=True).select("chunk_id", "repo_id", "file_path", F.col("batch").alias("old_batch"))
            gone = known.join(newest.select("repo_id", "file_path"), ["repo_id", "file_path"], "left_semi").select("chunk_id", "old_batch")
        for name, table in (("replaced", gone), ("chunks", chunks), ("postings", bm25.postings(tokens)), ("doc_stats", bm25.doc_stats(tokens))):
            table.write.mode("overwrite").parquet(f"{target}/{name}/batch={number}")
    finally:
        for table in (tokens, chunks, newest):
            table.unpersist()


def ingest_stream(rows: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Start keeping chunks, postings and statistics of a stream of files (FILES) below ``target``."""

    def write(batch: DataFrame, number: int) -> None:
        write_batch(batch, number, target)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_ingestion(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_trigger: int = 100) -> StreamingQuery:
    """Ingest Parquet files of FILES' schema from ``source`` as they appear."""
    rows = spark.readStream.schema(FILES).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    return ingest_stream(rows, target, checkpoint)


def ingested(spark: SparkSession, target: str, name: str, before: int | None = None, with_batch: bool = False) -> DataFrame:
    """The rows of ``chunks``, ``postings`` or ``doc_stats`` that count, or that did before a batch."""
    rows = spark.read.parquet(f"{target}/{name}")
    gone = spark.read.schema(REPLACED).parquet(f"{target}/replaced")
    if before is not None:
        rows, gone = rows.where(F.col("batch") < before), gone.where(F.col("batch") < before)
    found = rows.join(gone.select("chunk_id", F.col("old_batch").alias("batch")), ["chunk_id", "batch"], "left_anti")
    return found if with_batch else found.drop("batch")


def windowed_counts(events: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events per type and window of event time; works on streams and on tables. An extension beyond retrieval."""
    if events.isStreaming:
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return (
        events.groupBy(F.window("ts", window), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))
        .select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
    )
