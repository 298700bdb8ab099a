"""The evaluation job on a small corpus with known answers, run again, and over grown input."""

import math

import pytest

from jobs import evaluate_search as job

DOCS = "doc_id long, source string, lang string, text string"
PASSAGES = "item_id long, text string"
DOCUMENTS = [(k, "s", "en", f"filler{k} words here") for k in range(8)] + [
    (10, "s", "en", "some text with the quick brown fox inside"),
    (11, "t", "de", "the quick brown fox, twice: the quick brown fox and much more text around it to make it long"),
    (12, "t", "de", "brown and quick but the other way round, fox"),
    (13, "t", None, None),
]


@pytest.fixture
def paths(spark, tmp_path):
    documents, passages = str(tmp_path / "documents"), str(tmp_path / "passages")
    spark.createDataFrame(DOCUMENTS, DOCS).write.parquet(documents)
    spark.createDataFrame([(1, "quick brown fox"), (2, "never seen anywhere"), (3, None), (4, "x" * 250), (None, "quick")], PASSAGES).write.parquet(passages)
    return documents, passages, str(tmp_path / "out")


def rows(df):
    return sorted(map(str, df.collect()))


def test_quality_and_results(spark, paths):
    quality = {r["query_id"]: r for r in job.run(spark, *paths).collect()}
    assert sorted(quality) == [1, 2, 4] and quality[4]["category"] == "medium"
    assert quality[2]["n_relevant"] == 0 and quality[2]["ndcg"] == 0 and quality[2]["first_rank"] is None and quality[2]["recall"] == [0, 0, 0]
    found = {r["doc_id"]: r for r in spark.read.schema(job.RESULTS).parquet(f"{paths[2]}/results").where("query_id = 1").collect()}
    assert {d for d, r in found.items() if r["relevant"]} == {10, 11} and set(found) == {10, 11, 12}
    ranks = [found[d]["rank"] for d in (10, 11)]
    ideal = 1 + 1 / math.log2(3)
    assert quality[1]["ndcg"] == round(sum(1 / math.log2(r + 1) for r in ranks) / ideal, 6)
    assert quality[1]["first_rank"] == min(ranks) and quality[1]["recall"] == [1.0, 1.0, 1.0]


def test_run_again_and_over_grown_input(spark, paths):
    first = rows(job.run(spark, *paths))
    results = rows(spark.read.parquet(f"{paths[2]}/results"))
    assert rows(job.run(spark, *paths)) == first
    assert rows(spark.read.parquet(f"{paths[2]}/results")) == results
    spark.createDataFrame([(20, "s", "fr", "a quick brown fox again")], DOCS).write.mode("append").parquet(paths[0])
    grown = {r["query_id"]: r for r in job.run(spark, *paths).collect()}
    assert grown[1]["n_relevant"] == 3 and len(grown) == 3


def test_empty_tables(spark, tmp_path):
    documents, passages = str(tmp_path / "documents"), str(tmp_path / "passages")
    spark.createDataFrame([], DOCS).write.parquet(documents)
    spark.createDataFrame([(1, "quick")], PASSAGES).write.parquet(passages)
    assert [r["n_relevant"] for r in job.run(spark, documents, passages, str(tmp_path / "out")).collect()] == [0]
    spark.createDataFrame([], PASSAGES).write.mode("overwrite").parquet(passages)
    assert job.run(spark, documents, passages, str(tmp_path / "other")).collect() == []
