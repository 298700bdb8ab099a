"""Parquet tables of a data directory, and the folder that a cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of up to so many bytes are dealt over all cores; the shuffle moves no more than that.
SMALL_TABLE = 256 << 20


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``directory`` (any path that Spark's readers open)."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt over all cores where a small scan has fewer partitions than there are cores, as with one small file.

    For work that costs far more than reading. A scan with enough partitions stays as it is, and so does one of over SMALL_TABLE bytes:
    ``spark.sql.files.maxPartitionBytes`` says how finely that is split.
    """
    stored = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if stored <= SMALL_TABLE and rows.rdd.getNumPartitions() < cores else rows


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Only a master that runs in this one process may go without; a temporary folder stands in for it there.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def kept(spark: SparkSession, **tables: DataFrame) -> list[DataFrame]:
    """Tables written below the shared folder and read back, so that what several parts of a plan read is worked out once."""
    base, out = f"{shared_folder(spark)}/kept/{uuid.uuid4().hex}", []
    for name, rows in tables.items():
        rows.write.parquet(f"{base}/{name}")
        out.append(spark.read.schema(rows.schema).parquet(f"{base}/{name}"))
    return out
