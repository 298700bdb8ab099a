"""Helpers that several operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_folder, spread
from ..sources.tables import table as stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``directory``; a small one is dealt over all cores where its scan has fewer partitions."""
    return spread(stored(spark, directory, name))


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def broadcast_up_to(df: DataFrame, most_rows: int, cells: Column | None = None, most_cells: int = 0) -> DataFrame:
    """``df`` with a broadcast hint where it has at most ``most_rows`` rows (they are counted), else as it is. Materialize it before.

    Where rows hold arrays or bytes, ``cells`` is a row's number of them; all rows together may have ``most_cells``.
    """
    if cells is None:
        return F.broadcast(df) if df.count() <= most_rows else df
    rows, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(cells.cast("long")), F.lit(0))).first()
    return F.broadcast(df) if rows <= most_rows and total <= most_cells else df


def unused_name(columns: list[str], wish: str) -> str:
    """``wish``, or the first ``wish_1``, ``wish_2``, ... that is no column yet, whatever the case of letters."""
    taken = {c.lower() for c in columns}
    return next(name for k in range(len(taken) + 1) if (name := f"{wish}_{k}" if k else wish).lower() not in taken)


def without_rows(documents: DataFrame, value: Column, name: str, dropped: DataFrame, repeated: DataFrame, most_broadcast: int) -> DataFrame:
    """``documents`` without the rows of ``dropped`` (doc_id, ``name``), and with one row only of each in ``repeated``; ``value`` gives a row's ``name``.

    Rows with a null doc_id stay. Lists of up to ``most_broadcast`` rows are broadcast; then no text is shuffled.
    """
    own = unused_name(documents.columns, name)
    key = ["doc_id", own]
    dropped, repeated = (materialize(x).withColumnRenamed(name, own) for x in (dropped, repeated))
    stay = documents.withColumn(own, value).join(broadcast_up_to(dropped, most_broadcast), key, "left_anti")
    if repeated.isEmpty():
        return stay.select(*documents.columns)
    twice = broadcast_up_to(repeated, most_broadcast)
    once = stay.join(twice, key, "left_anti").unionByName(stay.join(twice, key, "left_semi").dropDuplicates(key))
    return once.select(*documents.columns)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII takes the faster built-in, with the same result."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as a Parquet table in the shared folder, and read it back; with the table's path, for ``removed``.

    For tables with whole texts, which a checkpoint would keep uncompressed.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}/{name}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder), folder


def removed(spark: SparkSession, folder: str) -> None:
    """Delete a table that ``written`` wrote."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder).getParent()
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
