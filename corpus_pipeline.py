"""The corpus pipeline: documents are filtered for quality, deduplicated exactly and nearly, and packed.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns the next stage's docs, which
the driver, or ``run``, writes as Parquet and reads again. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stratasearch.llm import exact_dedup, minhash_join, packing, quality_crf
from stratasearch.llm.common import removed, table, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.3 or more; the classifier learns from the labels outside its held-out rows."""
    return quality_crf.keep_good(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similarity 0.8 or more over five-word shingles connect, the one with the least doc_id."""
    return minhash_join.drop_near_duplicates(docs, words=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 ids."""
    return packing.pack_documents(
        docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), window=2048
    )


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("packing", pack),
]

#: The classifier, the similarity join and the packing go beyond SQL; tests compare the stages with direct versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, all stages applied to the documents of ``sf_dir``.

    A stage's table is deleted when the next one's is written; the last of them stays, as the result may read it.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, folder = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        if before is not None:
            removed(spark, before)
        before = folder
    return STAGES[-1][1](spark, docs, sf_dir)
