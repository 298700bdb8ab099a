"""Keep a keyword index of a growing folder of documents up to date.

    python -m jobs.index_documents [--config FILE] SOURCE TARGET CHECKPOINT

SOURCE is a folder (or pattern) of Parquet files. A run takes the files that no run with this CHECKPOINT has taken, and ends. Of a
document that comes again, only another text or path counts: its new chunks replace the old ones. An unchanged document writes nothing.

Below TARGET: ``documents`` (doc_id, repo_id, file_path, digest; by batch and language), ``chunks`` (by batch and language; numbered within the batch),
``postings`` (lists of numbers by batch and token bucket, sorted by token; ids of chunks would take most of the room) and ``replaced`` (doc_id and the batch
whose rows no longer count). A batch overwrites its own folders, so one that is run again after a failure leaves the same rows. Rows are only added: read
through ``current``. Texts and chunks are neither cached nor shuffled in a first batch: a later step reads what an earlier one wrote.

The configuration gives SQL expressions for id, repo, path, language and content over the source's columns.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratasearch.operators import bm25
from stratasearch.operators.chunking import line_chunks, with_chunk_ids
from stratasearch.operators.filters import readable_files

log = logging.getLogger("index_documents")

#: Repeated, changed or unchanged ids of a batch that are broadcast; with more of them the texts are shuffled.
FEW_REPEATED = 100_000

DEFAULTS = Path(__file__).with_suffix(".json")
SCHEMAS = {
    "documents": "doc_id long, repo_id string, file_path string, digest string, batch int, language string",
    "chunks": "doc_id long, repo_id string, chunk_id string, file_path string, start_line int, end_line int, content string, content_hash string, "
    "n_tokens long, n_terms long, number long, batch int, language string",
    "postings": "token string, block long, places array<smallint>, tfs array<int>, batch int, bucket int",
    "replaced": "doc_id long, old_batch int, batch int",
}


def stored(spark: SparkSession, target: str, name: str) -> DataFrame:
    """All rows ever written of one table."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{target}/{name}")


def current(spark: SparkSession, target: str, name: str = "chunks", before: int | None = None) -> DataFrame:
    """The rows of ``documents``, ``chunks`` or ``postings`` that count, or that did before a batch. Only the list of replaced documents is joined.

    Postings (token, chunk_id, repo_id, doc_id, tf, batch, bucket) take ids from the chunks that count, so filters on token and bucket are best put on the result.
    """
    if name == "postings":
        chunks = current(spark, target, "chunks", before).select("batch", "number", "chunk_id", "repo_id", "doc_id")
        listed = bm25.unlisted(stored(spark, target, name)).join(chunks, ["batch", "number"])
        return listed.select("token", "chunk_id", "repo_id", "doc_id", "tf", "batch", "bucket")
    rows, gone = stored(spark, target, name), stored(spark, target, "replaced")
    if before is not None:
        rows, gone = rows.where(F.col("batch") < before), gone.where(F.col("batch") < before)
    return rows.join(gone.select("doc_id", F.col("old_batch").alias("batch")), ["doc_id", "batch"], "left_anti")


def _newest(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per doc_id: of the newest file, then the last one by path, then by a hash; and the ids that come more than once, which are persisted.

    Texts of ids that come once aren't moved, up to FEW_REPEATED others.
    """
    order = F.struct("modified", "file", F.xxhash64("repo_id", "file_path", "language", "content").alias("hash"))
    rows = rows.withColumn("order", order)
    repeated = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("order").alias("newest")).where("n > 1").drop("n").persist()
    few = F.broadcast(repeated) if repeated.count() <= FEW_REPEATED else repeated
    once = rows.join(few.select("doc_id"), "doc_id", "left_anti")
    chosen = rows.join(few, "doc_id").where("order = newest").dropDuplicates(["doc_id"])
    return once.unionByName(chosen.drop("newest")).drop("order", "modified", "file"), repeated


def write_batch(rows: DataFrame, number: int, target: str, settings: dict) -> int:
    """Index one batch of documents (doc_id, repo_id, file_path, language, content, modified, file); returns the number of rows read."""
    spark = rows.sparkSession
    digest = F.sha2(F.to_json(F.struct("repo_id", "file_path", "language", "content")), 256)
    newest, repeated = _newest(rows.where("doc_id IS NOT NULL"))
    names = ("doc_id", "repo_id", "file_path", "digest", "language")
    if number:  # as it was before this batch, also if the batch is run again
        known = current(spark, target, "documents", before=number)
    else:
        known = spark.createDataFrame([], SCHEMAS["documents"])
    known = known.select("doc_id", "digest", F.col("batch").alias("old_batch"))
    given = newest.withColumn("digest", digest).select(*names)  # without texts
    changed = given.join(known.select("doc_id", "digest"), ["doc_id", "digest"], "left_anti").select(*names).persist()

    def write(table: DataFrame, name: str, *by: str) -> DataFrame:
        path = f"{target}/{name}/batch={number}"
        table.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(path)  # ids in hex take half the room
        fields = [f for f in T.StructType.fromDDL(SCHEMAS[name]).fields if f.name != "batch"]
        return spark.read.schema(T.StructType(fields)).parquet(path)

    try:
        replaced = changed.join(known.select("doc_id", "old_batch"), "doc_id").select("doc_id", "old_batch")
        read = rows.count()
        counts = {"replaced": write(replaced, "replaced").count()}
        texts = _with_ids(newest, changed) if number else newest
        pieces = with_chunk_ids(line_chunks(readable_files(texts), settings["desired_chunk_chars"], settings["max_chunk_chars"]))
        columns = ("doc_id", "repo_id", "chunk_id", "file_path", "start_line", "end_line", "content", "content_hash")
        numbered = pieces.select(*columns, F.monotonically_increasing_id().alias("number"), "language", bm25.index_text("content", "file_path").alias("text"))
        sized = bm25.with_sizes(numbered).select(*columns, "n_tokens", "n_terms", "number", "language")
        chunks = write(sized, "chunks", "language")
        counts["chunks"] = chunks.count()
        posted = bm25.postings(chunks.select("number", bm25.index_text("content", "file_path").alias("text")))
        bucket = F.pmod(F.hash("token"), F.lit(settings["token_buckets"])).alias("bucket")
        dealt = posted.select("*", bucket).repartitionByRange("bucket", "token", "block").sortWithinPartitions("bucket", "token", "block")
        counts["postings"] = write(dealt, "postings", "bucket").agg(F.coalesce(F.sum(F.size("places")), F.lit(0))).first()[0]
        counts["documents"] = write(changed, "documents", "language").count()
        log.info("batch %d: read %d rows; wrote %s", number, read, ", ".join(f"{n} {name}" for name, n in counts.items()))
        return read
    finally:
        changed.unpersist()
        repeated.unpersist()


def _with_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` (each doc_id once) with the ids of ``ids``. Texts are moved only if more than FEW_REPEATED have such ids and more have none."""
    ids = ids.select("doc_id")
    if ids.count() <= FEW_REPEATED:
        return rows.join(F.broadcast(ids), "doc_id", "left_semi")
    others = rows.select("doc_id").join(ids, "doc_id", "left_anti")
    if others.count() <= FEW_REPEATED:
        return rows.join(F.broadcast(others), "doc_id", "left_anti")
    return rows.join(ids, "doc_id", "left_semi")


def run(spark: SparkSession, source: str, target: str, checkpoint: str, settings: dict | None = None) -> int:
    """Index what is new in ``source``; returns the number of rows read. Rows without an id are left out."""
    settings = json.loads(DEFAULTS.read_text()) | (settings or {})
    schema = spark.read.parquet(source).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", settings["files_per_batch"]).parquet(source)
    named = rows.select(
        F.expr(settings["id"]).cast("long").alias("doc_id"),
        F.expr(settings["repo"]).cast("string").alias("repo_id"),
        F.expr(settings["path"]).alias("file_path"),
        F.expr(settings["language"]).cast("string").alias("language"),
        F.coalesce(F.expr(settings["content"]), F.lit("")).alias("content"),
        F.col("_metadata.file_modification_time").alias("modified"),
        F.col("_metadata.file_path").alias("file"),
    )
    read: dict[int, int] = {}

    def write(batch: DataFrame, number: int) -> None:
        read[number] = write_batch(batch, number, target, settings)

    query = named.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("read %d rows in %d batches from %s", sum(read.values()), len(read), source)
    return sum(read.values())


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    parser.add_argument("--config", default=str(DEFAULTS))
    for name in ("source", "target", "checkpoint"):
        parser.add_argument(name)
    given = parser.parse_args(arguments)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s: %(message)s")
    settings = json.loads(Path(given.config).read_text())
    spark = SparkSession.builder.appName("index_documents").getOrCreate()
    try:
        run(spark, given.source, given.target, given.checkpoint, settings)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
