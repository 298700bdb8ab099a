"""Row filters of a file scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, looks_binary, looks_minified


def within_size(files: DataFrame, most_bytes: int = 1_000_000, size: str = "size") -> DataFrame:
    """Files of at most so many bytes."""
    return files.where(F.col(size) <= most_bytes)


def readable_files(files: DataFrame, path: str = "file_path", content: str = "content") -> DataFrame:
    """Files that are neither binary, minified nor blank; a null content is blank."""
    return files.where(~looks_binary(content) & ~looks_minified(path, content) & ~is_blank(content))


def with_languages(files: DataFrame, languages: list[str] | None = None, repos: list[str] | None = None) -> DataFrame:
    """Rows of the given languages and repositories; None takes all."""
    if languages:
        files = files.where(F.col("language").isin(languages))
    if repos:
        files = files.where(F.col("repo_id").isin(repos))
    return files
