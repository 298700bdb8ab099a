"""Evaluation tasks: queries with the files, or the lines, that answer them.

A file of tasks is a JSON list of objects with ``query``, ``relevant`` and ``secondary`` (each a list of paths, or of objects with path and
lines), and optionally ``category`` and ``repo``. As paths and objects mix in one list, every entry is read as text first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import infer_category

_TASK = "array<struct<query:string,relevant:array<string>,secondary:array<string>,category:string,repo:string>>"
_PLACE = "struct<path:string,start_line:int,end_line:int>"


def _target(entry: Column) -> Column:
    """A path, or an object with a path and lines, as a struct."""
    parsed = F.from_json(entry, _PLACE)
    return F.when(F.startswith(F.ltrim(entry), F.lit("{")), F.struct(parsed["path"].alias("path"), parsed["start_line"].alias("from_line"), parsed["end_line"].alias("to_line"))).otherwise(
        F.struct(entry.alias("path"), F.lit(None).cast("int").alias("from_line"), F.lit(None).cast("int").alias("to_line"))
    )


def parse_tasks(texts: DataFrame) -> DataFrame:
    """Tasks of rows (repo, json): query_id, repo, query, category, targets (structs of path, from_line, to_line, is_primary).

    ``query_id`` is a hash of repository and query. Texts that aren't a list of tasks give none.
    """
    tasks = texts.select(F.col("repo").alias("file_repo"), F.explode_outer(F.from_json("json", _TASK)).alias("t")).where("t.query IS NOT NULL")

    def targets(name: str, primary: bool) -> Column:
        entries = F.coalesce(F.col(f"t.{name}"), F.array().cast("array<string>"))
        marked = F.transform(entries, lambda e: F.struct(_target(e).alias("p"), F.lit(primary).alias("is_primary")))
        return F.transform(marked, lambda m: F.struct(m["p"]["path"].alias("path"), m["p"]["from_line"].alias("from_line"), m["p"]["to_line"].alias("to_line"), m["is_primary"].alias("is_primary")))

    repo = F.coalesce("t.repo", "file_repo")
    return tasks.select(
        F.xxhash64(repo, F.col("t.query")).alias("query_id"),
        repo.alias("repo"),
        F.col("t.query").alias("query"),
        F.coalesce("t.category", infer_category("t.query")).alias("category"),
        F.concat(targets("relevant", True), targets("secondary", False)).alias("targets"),
    )


def load_tasks(spark: SparkSession, directory: str) -> DataFrame:
    """Tasks of all ``*.json`` files of a directory; a file's name is the repository where a task names none."""
    texts = spark.read.text(f"{directory}/*.json", wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1).alias("repo"), F.col("value").alias("json")
    )
    return parse_tasks(texts)


def load_repos(spark: SparkSession, path: str) -> DataFrame:
    """Repositories to evaluate on: name, language, url, revision, benchmark_root."""
    kind = "name string, language string, url string, revision string, benchmark_root string"
    return spark.read.schema(kind).json(path, multiLine=True)


def task_targets(tasks: DataFrame) -> DataFrame:
    """One row per target: query_id, target_id, path, from_line, to_line, is_primary."""
    return tasks.select("query_id", F.posexplode("targets").alias("target_id", "t")).select("query_id", "target_id", "t.*")


def save_results(rows: DataFrame, directory: str, method: str, revision: str) -> str:
    """Write results (of an evaluation: a row per query at most) as the one JSON file ``<method>-<first twelve of the revision>.json``; returns its path.

    The file appears as a whole. The directory may be on any file system that Spark reaches.
    """
    path = f"{directory}/{method}-{revision[:12]}.json"
    spark = rows.sparkSession
    listed = rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("row")).toPandas()["row"]
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    new = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.new")
    stream = files.create(new, True)
    stream.write(bytearray(("[\n" + ",\n".join(listed) + "\n]\n").encode()))
    stream.close()
    files.delete(target, False)
    files.rename(new, target)
    return path


def tasks_by_repo(tasks: DataFrame) -> DataFrame:
    """(repo, tasks): the tasks of each repository as one list, in the order of queries and ids."""
    task = F.struct("query", "query_id", "category", "targets")
    return tasks.groupBy("repo").agg(F.array_sort(F.collect_list(task)).alias("tasks"))
