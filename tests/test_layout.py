"""Scoped reads: only the buckets of the scopes are read, which is shown by taking the other folders away."""

import shutil
from pathlib import Path

import pytest

from stratasearch.operators import layout


@pytest.fixture
def stored(spark, tmp_path):
    rows = [(k, f"repo{k % 40}" if k % 41 else None, f"text {k}") for k in range(2000)] + [(k, "hot", "x" * 50) for k in range(2000, 3000)]
    frame = spark.createDataFrame(rows, "id long, repo_id string, content string")
    path = str(tmp_path / "rows")
    layout.write_by_repository(frame, path, "repo_id", buckets=16)
    return rows, path


def bucket(spark, repo):
    return spark.createDataFrame([(repo,)], "repo string").select(layout.bucket_of(layout.F.col("repo"), 16)).first()[0]


def test_only_the_buckets_of_the_scopes_are_read(spark, stored):
    rows, path = stored
    whole = spark.read.parquet(path)
    assert sorted(r["id"] for r in whole.collect()) == [k for k, _, _ in rows]
    scopes = spark.createDataFrame([("repo3",), ("hot",), ("nowhere",)], "scope string")
    kept = {bucket(spark, x) for x in ("repo3", "hot", "nowhere")}
    found = layout.in_scopes(whole, scopes, 16)
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString().lower()
    for folder in Path(path).glob("bucket=*"):
        if int(folder.name.split("=")[1]) not in kept:
            shutil.rmtree(folder)
    got = found.collect()  # the folders are listed already: reading a file of another bucket would fail
    assert {r["bucket"] for r in got} <= kept
    want = [k for k, repo, _ in rows if repo in ("repo3", "hot")]
    assert sorted(r["id"] for r in got if r["repo_id"] in ("repo3", "hot")) == want
    with pytest.raises(Exception, match="FAILED_READ_FILE|FileNotFound|does not exist|NOT_EXIST"):
        whole.collect()


def test_a_null_scope_reads_everything(spark, stored):
    rows, path = stored
    whole = spark.read.parquet(path)
    for scopes in ([(None,)], [(None,), ("hot",)]):
        assert layout.in_scopes(whole, spark.createDataFrame(scopes, "scope string"), 16).count() == len(rows)
    assert layout.in_scopes(whole, spark.createDataFrame([], "scope string"), 16).count() == 0
