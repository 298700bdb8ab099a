"""Lines end at every character that ends a line in Unicode text, and are found about as fast as words."""

import itertools
import time

from pyspark.sql import functions as F

from stratasearch.functions.text import lines_of

ENDS = ["\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", " ", " "]


def test_every_end(spark):
    parts = [*ENDS, "a", "", "\x1f\t", "é😀"]
    texts = ["".join(x) for n in (1, 2, 3) for x in itertools.product(parts, repeat=n)] + ["", "a b\n\n\r\n\rc", "\n" * 5 + "x"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", lines_of("text").alias("lines")).collect()
    assert len(rows) == len(texts)
    for row in rows:
        assert row["lines"] == row["text"].splitlines(keepends=True)


def test_as_fast_as_words(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = docs.crossJoin(spark.range(20)).select(F.concat("text", F.col("id").cast("string")).alias("text")).repartition(4).persist()
    rows.count()

    def seconds(column):
        least = []
        for _ in range(3):
            began = time.time()
            rows.agg(F.sum(F.size(column))).collect()
            least.append(time.time() - began)
        return min(least)

    words = F.regexp_extract_all("text", F.lit("[a-zA-Z_][a-zA-Z0-9_]*"), F.lit(0))
    spent = seconds(lines_of("text")), seconds(words)
    assert spent[0] < 2 * spent[1], spent
    rows.unpersist()
