"""Text and path expressions on rows with known results."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratasearch.functions import paths, plain, text
from stratasearch.functions.languages import Languages, detect_language


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}")
    return [r["y"] for r in rows.select("k", expression(F.col("x")).alias("y")).orderBy("k").collect()]


def test_split_identifier(spark):
    cases = {
        "HandlerStack": "handlerstack,handler,stack", "getHTTPResponse": "gethttpresponse,get,http,response", "XMLParser": "xmlparser,xml,parser",
        "my_func": "my_func,my,func", "_private": "_private", "myHTTP_Client": "myhttp_client,myhttp,client", "simple": "simple", "utf8": "utf8,utf,8",
    }
    got = column(spark, list(cases), lambda x: F.array_join(text.split_identifier(x), ","))
    assert got == list(cases.values())
    assert [",".join(plain.identifier_parts(t)) for t in cases] == list(cases.values())


def test_tokens_equal_plain_python(spark):
    samples = ["def getUser(self): return my_var", "", None, "É1 a_b__c HTTPServer2Go x9", "İK ＡＢ", "a.b->c::d\n\tx"]
    assert column(spark, samples, text.tokenize) == [plain.tokenize(s) for s in samples]


def test_predicates(spark):
    assert column(spark, ["PK\x03\x04\x00\x00stuff", "", "��abcdefgh", "�abcdefghi", None], text.looks_binary) == [True, False, True, False, False]
    minified = lambda name: lambda x: text.looks_minified(F.lit(name), x)
    assert column(spark, ["a"], minified("x.MIN.js")) == [True]
    assert column(spark, ["a" * 100_000, "x = 1\n" * 2000, "", None], minified("x.js")) == [True, False, False, False]
    assert column(spark, ["", " \n\t", " x ", None, "\u3000"], text.is_blank) == [True, True, False, True, True]


def test_queries(spark):
    queries = ["MyService", "Sinatra::Base", "_x", "session", "how does routing work", " getUser ", "a.b", "HTTP", "a b"]
    assert column(spark, queries, text.is_symbol_query) == [True, True, True, False, False, True, True, True, False]
    assert column(spark, ["Sinatra::Base", "a->b.c", "x\\y", "Client", " p.q"], text.symbol_leaf) == ["Base", "b.c", "y", "Client", "q"]
    assert column(spark, ["how does MyService call getUser in HTTP"], text.embedded_symbols) == [["MyService", "getUser"]]
    assert column(spark, ["the Auth of auth and to_do"], text.query_keywords) == [["auth", "to_do"]]
    assert column(spark, ["x", "how it works", "find the parser"], text.infer_category) == ["symbol", "architecture", "semantic"]


@pytest.mark.parametrize(
    "content,name,found",
    [
        ("class MyService:", "MyService", True), ("x = MyService()", "MyService", False), ("defmodule Phoenix.Router do", "Router", True), ("subclass Base", "Base", False),
        ("create table Users (id int)", "Users", True), ("Class Base", "Base", False), ("fn\n  main()", "main", True), ("def f(x", "f(x", True), ("type T[K]", "T", True),
        ("def run_all", "run", False),
    ],
)
def test_definitions(spark, content, name, found):
    assert column(spark, [content], lambda x: text.defines(x, F.lit(name))) == [found]


def test_names(spark):
    sources = ["https://example.com/a/tool.git", "/home/me/tool/", "git@example.com:a/tool.git", "tool", "/"]
    assert column(spark, sources, text.display_name) == ["tool", "tool", "tool", "tool", "/"]
    assert column(spark, sources, text.is_git_url) == [True, False, True, False, False]


def test_paths(spark):
    files = ["src/my_mod.py", ".gitignore", "a/b.tar.gz", "Makefile", "./x//y.c", "..a.rs", ""]
    assert column(spark, files, paths.stem_of) == ["my_mod", ".gitignore", "b.tar", "Makefile", "y", "..a", ""]
    assert column(spark, files, paths.suffix_of) == [".py", "", ".gz", "", ".c", ".rs", ""]
    assert column(spark, ["a/b/c/d/e.py", "e.py", "a/e.py"], paths.last_directories) == ["b c d", "", "a"]
    assert column(spark, ["a/b/e.py", "e.py", "../e.py"], paths.parent_name) == ["b", "", ""]


def test_path_penalty(spark):
    cases = {
        "src/main.py": 1.0, "src/p/__init__.py": 0.5, "tests/test_auth.py": 0.3, "tests/__init__.py": 0.15, "src/compat/old_api.py": 0.3, "examples/demo.py": 0.3,
        "examples/tests/test_x.py": 0.09, "src/types/index.d.ts": 0.7, "pkg/foo_test.go": 0.3, "FooTest.java": 0.3, "src\\legacy\\a.c": 0.3, "a/contest.py": 1.0,
    }
    assert [round(x, 6) for x in column(spark, list(cases), paths.path_penalty)] == list(cases.values())


def test_languages(spark):
    known = Languages()
    assert known.detect("a/B.PY") == "python" and known.detect(".py") is None and known.detect("x.unknown") is None
    assert ".md" in known.extensions(True) and ".md" not in known.extensions() and ".zz" in known.extensions(more=[".zz"])
    more = known.extended({"zz": "zlang", ".notes": "notes"}, documents=("notes",))
    assert more.detect("a.ZZ") == "zlang" and ".notes" not in more.extensions() and ".notes" in more.extensions(True)
    table = spark.createDataFrame([(".qq", "qlang")], "extension string, language string")
    assert known.extended(table).detect("x.qq") == "qlang"
    files = spark.createDataFrame([("a.py",), ("b.zz",), ("c",)], "file_path string")
    assert {r["file_path"]: r["language"] for r in more.with_language(files).collect()} == {"a.py": "python", "b.zz": "zlang", "c": None}
    assert column(spark, ["a.py", "c"], lambda x: detect_language(x, known.table)) == ["python", None]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="aB_9 .\n", max_size=30), min_size=1, max_size=20))
def test_tokenize_property(spark, samples):
    assert column(spark, samples, text.tokenize) == [plain.tokenize(s) for s in samples]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aBz_09 .é\n\x00", max_size=14), st.text(max_size=20)), max_size=6))
def test_lists_of_tokens_equal_plain_python(samples):
    import pyarrow as pa

    texts = pa.array([s and s.encode("utf-8", "replace").decode() for s in [*samples, "9"]], pa.string())
    want = [plain.tokenize(s) for s in texts.to_pylist()]
    assert plain.token_lists(texts).to_pylist() == want
    assert plain.token_lists(texts.slice(1)).to_pylist() == want[1:]
