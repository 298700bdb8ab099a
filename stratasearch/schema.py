"""Schemas of the stored tables and of results."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


FILES = _struct(("repo_id", S), ("file_path", S), ("language", S), ("content", S))
CHUNK = _struct(("content", S), ("file_path", S), ("start_line", I), ("end_line", I), ("language", S))
CHUNKS = _struct(
    ("chunk_id", S), ("repo_id", S), ("file_path", S), ("start_line", I), ("end_line", I), ("language", S), ("content", S), ("content_hash", S)
)
VECTORS = _struct(("chunk_id", S), ("namespace", S), ("vector", T.ArrayType(T.FloatType())), ("embed_error", S))
POSTINGS = _struct(("token", S), ("chunk_id", S), ("repo_id", S), ("tf", I))
DOC_STATS = _struct(("chunk_id", S), ("repo_id", S), ("dl", I))
REPOS = _struct(
    ("repo_id", S),
    ("source", S),
    ("source_path", S),
    ("include_text_files", T.BooleanType()),
    ("embedding_model", S),
    ("embedding_dim", I),
    ("chunker_version", S),
    ("commit_sha", S),
    ("indexed_at", T.TimestampType()),
    ("chunk_count", L),
    ("version", L),
)
