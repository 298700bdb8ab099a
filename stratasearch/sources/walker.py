"""Scanning repository trees.

The listing is made on the driver, which has to read ignore files from the top down; contents are read by the executors, in parallel. Spark's own
file sources are not used here, as they leave out names that start with ``_`` or ``.``.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.languages import Languages
from ..operators.filters import readable_files
from .ignore import GIT_IGNORE, IGNORED_DIRECTORIES, OWN_IGNORE, Rules, decide, parse_lines


def _rules_of(directory: str, base: str) -> Rules | None:
    lines: list[str] = []
    for name in (GIT_IGNORE, OWN_IGNORE):
        path = os.path.join(directory, name)
        if os.path.isfile(path):
            with open(path, encoding="utf-8", errors="ignore") as file:
                lines += file.read().splitlines()
    patterns = parse_lines(lines)
    return Rules(base, patterns) if patterns else None


def walk(root: str, extensions: Sequence[str], ignore: Sequence[str] = ()) -> Iterator[tuple[str, int, int]]:
    """(path below the root, bytes, modification time in ns) of each file to index, in sorted order.

    Links are not followed; what can't be read is left out. A file is taken for its extension, or because a negated pattern with a
    suffix names it.
    """
    wanted = frozenset(extensions)
    top = Rules("", parse_lines([*sorted(IGNORED_DIRECTORIES), *ignore]))
    waiting: list[tuple[str, list[Rules]]] = [("", [top])]
    while waiting:
        base, stack = waiting.pop()
        directory = os.path.join(root, base) if base else root
        own = _rules_of(directory, base)
        if own is not None:
            stack = [*stack, own]
        below = []
        try:
            items = sorted(os.scandir(directory), key=lambda e: e.name)
        except OSError:
            continue
        for item in items:
            path = f"{base}/{item.name}" if base else item.name
            try:
                if item.is_symlink():
                    continue
                is_directory = item.is_dir()
                ignored, by_kind = decide(path, is_directory, stack)
                if ignored:
                    continue
                if is_directory:
                    below.append((path, stack))
                elif item.is_file() and (by_kind or _suffix(item.name) in wanted):
                    stat = item.stat()
                    yield path, stat.st_size, stat.st_mtime_ns
            except OSError:
                continue
        waiting += reversed(below)


def _suffix(name: str) -> str:
    stem, dot, suffix = name.rpartition(".")
    return f".{suffix.lower()}" if dot and stem.strip(".") else ""


_CONTENTS = "file_path string, size long, content string"


def _read(root: str):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, size in zip(batch["file_path"], batch["size"]):
                try:
                    with open(os.path.join(root, path), "rb") as file:
                        content = file.read().decode("utf-8", "replace")
                except OSError:
                    continue
                yield pd.DataFrame({"file_path": [path], "size": [size], "content": [content]})

    return read


def scan_files(
    spark: SparkSession,
    root: str,
    repo_id: str,
    include_text_files: bool = False,
    languages: Languages | None = None,
    most_bytes: int = 1_000_000,
    ignore: Sequence[str] = (),
    files_per_task: int = 200,
) -> DataFrame:
    """(repo_id, file_path, language, content) of the files to index. The root must be readable on every executor."""
    languages = languages or Languages()
    listed = [(p, n) for p, n, _ in walk(root, languages.extensions(include_text_files), ignore) if n <= most_bytes]
    tasks = max(1, -(-len(listed) // files_per_task))
    paths = spark.createDataFrame(listed, "file_path string, size long").repartition(tasks)
    contents = paths.mapInPandas(_read(root), _CONTENTS)
    return (
        languages.with_language(readable_files(contents))
        .withColumn("repo_id", F.lit(repo_id))
        .select("repo_id", "file_path", "language", "content")
    )


def tree_fingerprint(files: DataFrame) -> DataFrame:
    """One row per repository with a hash over (file_path, size, mtime_ns), in the order of the paths."""
    entry = F.concat_ws("|", "file_path", "size", "mtime_ns")
    return files.groupBy("repo_id").agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file_path", entry.alias("e")))), lambda x: x["e"]), "\n"), 256).alias("fingerprint")
    )
