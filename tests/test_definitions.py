"""Texts that can't define a name are not searched with the patterns; what defines one is the same."""

import pytest
from pyspark.sql import functions as F

from stratasearch.functions.text import defines


@pytest.mark.parametrize(
    "content,name,want",
    [
        ("class A::Foo {", "Foo", True), ("subclass Foo", "Foo", False), ("class foo", "Foo", False), ("x\ndef f(x", "f(x", True), ("create TABLE app.USERS (id)", "users", True),
        ("create  table users", "users", False), ("CREATE VIEW other", "users", False), ("class \\EFoo", "\\EFoo", True), ("type É;", "É", True), ("class X", "", False), ("", "Foo", False), (None, "Foo", None), ("class Foo", None, None),
    ],
)
def test_defines(spark, content, name, want):
    rows = spark.createDataFrame([(content, name)], "content string, name string")
    assert rows.select(defines("content", F.col("name")).alias("found")).first()["found"] is want


def test_texts_without_the_name_are_left_out(spark):
    """Keywords all over and many names: the patterns come behind a plain search for the name."""
    texts = spark.range(0, 400, 1, 2).select(F.concat(F.repeat(F.lit("type of record and class or def "), 200), F.col("id").cast("string")).alias("content")).persist()
    names = spark.createDataFrame([(f"Name{k}",) for k in range(20)], "name string")
    rows = texts.crossJoin(F.broadcast(names)).select(defines("content", F.col("name")).alias("found"))
    assert rows.where("found").count() == 0
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "contains(" in plan.lower()
    assert rows.where("NOT found").count() == 8000
