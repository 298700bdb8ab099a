"""BM25, dense search, fusion, ranking, joins and evaluation on rows with worked results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratasearch.operators import bm25, dense, evaluation, fusion, lookups, ranking

CHUNKS = [
    ("auth", "r", "auth.py", "def authenticate token pass"),
    ("users", "r", "users.py", "class userservice user service pass"),
    ("utils", "r", "utils.py", "def format_x return"),
]


def corpus(spark, tokens=None):
    rows = tokens or {
        "auth": "def authenticate token pass auth auth",
        "users": "def userservice user service pass users users".replace("def", "class"),
        "utils": "def format_date format date dt return dt utils utils",
    }
    frame = spark.createDataFrame([(k, "r", v.split(" ")) for k, v in rows.items()], "chunk_id string, repo_id string, tokens array<string>")
    return bm25.postings(frame), bm25.doc_stats(frame)


def ask(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")


@pytest.mark.parametrize(
    "query,want",
    [
        ("authenticate token", {"auth": 2.136460}),
        ("pass", {"auth": 0.511885, "users": 0.479818}),
        ("pass pass", {"auth": 1.023770, "users": 0.959636}),
        ("def dt", {"auth": 0.511885, "utils": 1.732189}),
        ("format_date", {"utils": 2.669473}),
        ("", {}),
    ],
)
def test_bm25(spark, query, want):
    got = bm25.scores(ask(spark, query), *corpus(spark)).collect()
    assert {r["chunk_id"]: round(r["score"], 6) for r in got} == want


def test_bm25_removal_undoes_addition(spark):
    posted, stats = corpus(spark)
    extra, extra_stats = corpus(spark, {"new": "pass pass token", "auth": "changed"})
    more, more_stats = bm25.with_chunks(posted, extra), bm25.with_chunks(stats, extra_stats)
    assert more_stats.count() == 4
    gone = extra_stats.where("chunk_id = 'new'")
    back = bm25.without_chunks(more, gone)
    kept = back.where("chunk_id <> 'auth'").select(posted.columns).exceptAll(posted.where("chunk_id <> 'auth'"))
    assert kept.count() == 0 and bm25.without_chunks(more_stats, gone).count() == 3


def test_selector_and_index_tokens(spark):
    posted, stats = corpus(spark)
    only = spark.createDataFrame([("users",)], "chunk_id string")
    got = bm25.scores(ask(spark, "pass"), posted, stats, only).collect()
    assert [(r["chunk_id"], round(r["score"], 6)) for r in got] == [("users", 0.479818)]  # frequencies of all chunks
    each = spark.createDataFrame([(0, "auth")], "query_id int, chunk_id string")
    assert [r["chunk_id"] for r in bm25.scores(ask(spark, "pass"), posted, stats, each).collect()] == ["auth"]
    rows = spark.createDataFrame([("a/b/c/d/my_mod.py", "x")], "p string, c string")
    assert rows.select(bm25.index_tokens("c", "p").alias("t")).first()["t"] == ["x", "my_mod", "my", "mod", "my_mod", "my", "mod", "b", "c", "d"]


def vectors(spark):
    rows = [("a", "n1", [1.0, 0.0]), ("b", "n1", [0.6, 0.8]), ("c", "n2", [0.0, 2.0]), ("d", "n2", None), ("e", "n2", [0.6, 0.8])]
    return spark.createDataFrame(rows, "chunk_id string, namespace string, vector array<double>")


@pytest.mark.parametrize("metric,want", [("ip", [("c", 2.0), ("b", 0.8), ("e", 0.8)]), ("cosine", [("c", 1.0), ("b", 0.8), ("e", 0.8)]), ("l2", [("b", 1 / 1.4), ("e", 1 / 1.4), ("c", 0.5)])])
def test_nearest(spark, metric, want):
    rounded = [(c, round(s, 6)) for c, s in want]
    one = dense.nearest(vectors(spark), [0.0, 1.0], 3, metric).orderBy("rank").collect()
    assert [(r["chunk_id"], round(r["score"], 6)) for r in one] == rounded
    asked = spark.createDataFrame([(7, [0.0, 1.0]), (8, None)], "query_id int, vector array<double>")
    many = dense.batch_nearest(vectors(spark), asked, 3, metric).orderBy("rank").collect()
    assert [(r["query_id"], r["chunk_id"], round(r["score"], 6)) for r in many] == [(7, c, s) for c, s in rounded]
    assert dense.batch_nearest(vectors(spark), asked.limit(0), 3).count() == 0
    inside = dense.in_namespaces(vectors(spark), only=["n1"]), dense.in_namespaces(vectors(spark), without=["n1"])
    assert [r["chunk_id"] for r in dense.nearest(inside[0], [0.0, 1.0], 9).collect()] == ["b", "a"]
    assert {r["chunk_id"] for r in dense.nearest(inside[1], [0.0, 1.0], 9).collect()} == {"c", "e"}
    with pytest.raises(ValueError):
        dense.nearest(vectors(spark), [0.0, 1.0], 3, "other")


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(dense, "QUERY_BLOCK", 2)
    asked = spark.createDataFrame([(k, [float(k % 3), 1.0]) for k in range(5)], "query_id int, vector array<double>")
    got = dense.batch_nearest(vectors(spark), asked, 2).collect()
    assert len(got) == 10 and {r["query_id"] for r in got} == set(range(5))


class Flaky(dense.HashingEncoder):
    def encode(self, texts):
        if len(texts) > 1:
            raise RuntimeError("busy")
        if "bad" in texts[0]:
            raise RuntimeError("never")
        if len(texts[0]) > 300:
            raise RuntimeError("too many tokens")
        return super().encode(texts)


def test_encoders(spark):
    spark.sparkContext.addPyFile(__file__)  # the tasks need the class above
    plain = dense.HashingEncoder(16)
    vector = plain.encode(["alpha beta"])[0]
    assert np.isclose((vector * vector).sum(), 1) and not plain.encode([""])[0].any()
    tried = dense.RetryingEncoder(Flaky(16), retries=2)
    got = tried.encode(["alpha beta", "bad", "x " * 400])
    assert np.allclose(got[0], vector) and got[1] is None and got[2] is not None and tried.dim == 16 and tried.name == "hashing-16"
    rows = spark.createDataFrame([(1, "alpha beta"), (2, "bad"), (3, None)], "k int, content string")
    found = {r["k"]: r for r in dense.encoded(rows, dense.RetryingEncoder(Flaky(16), retries=1)).collect()}
    assert found[2]["vector"] is None and found[2]["embed_error"] and found[1]["embed_error"] is None and len(found[3]["vector"]) == 16
    unit = dense.prepared(vectors(spark).where("chunk_id = 'c'")).first()["vector"]
    assert unit == [0.0, 1.0]


def test_fusion(spark):
    kind = "query_id int, chunk_id string, score double"
    left = spark.createDataFrame([(0, "a", 2.0), (0, "b", 1.0)], kind)
    right = spark.createDataFrame([(0, "b", 9.0), (0, "c", 8.0)], kind)
    for alpha, want in ((0.5, {"a": 0.008197, "b": 0.016261, "c": 0.008065}), (1.0, {"a": 0.016393, "b": 0.016129, "c": 0}), (0.0, {"a": 0, "b": 0.016393, "c": 0.016129})):
        alphas = spark.createDataFrame([(0, alpha)], "query_id int, alpha double")
        assert {r["chunk_id"]: round(r["score"], 6) for r in fusion.fuse(left, right, alphas).collect()} == want
    asked = ask(spark, "MyService", "Sinatra::Base", "_x", "session", "how does routing work")
    assert [r["a"] for r in asked.select("query_id", fusion.alpha_of("query").alias("a")).orderBy("query_id").collect()] == [0.3, 0.3, 0.3, 0.5, 0.5]


def candidates(spark, rows):
    kind = "query_id int, query string, repo_id string, chunk_id string, file_path string, content string, score double"
    return spark.createDataFrame(rows, kind)


def scores(found):
    return {r["chunk_id"]: round(r["score"], 6) for r in found.collect()}


def test_coherence(spark):
    rows = [(0, "q", "r", "a", "big.py", "", 1.0), (0, "q", "r", "b", "big.py", "", 0.8), (0, "q", "r", "c", "small.py", "", 1.0), (0, "q", "z", "d", "big.py", "", 0.0)]
    assert scores(ranking.coherence_boost(candidates(spark, rows))) == {"a": 1.2, "b": 0.8, "c": 1.111111, "d": 0.0}


@pytest.mark.parametrize(
    "query,path,content,want",
    [
        ("MyService", "src/my_service.py", "class MyService:", 2.75), ("MyService", "src/utils.py", "x = MyService()", 0.5), ("how does MyService work", "src/my_service.py", "class MyService:", 1.625),
        ("authenticate user session", "src/auth.py", "", 0.666667), ("auth service", "src/auth_service.py", "", 1.0), ("the and or", "src/and.py", "", 0.5),
    ],
)
def test_query_boosts(spark, query, path, content, want):
    got = scores(ranking.query_boost(candidates(spark, [(0, query, "r", "a", path, content, 0.5)])))
    assert got == {"a": want}


def test_saturation_and_merge(spark):
    rows = [(0, "q", "r", f"c{k}", "a.py", "", float(5 - k)) for k in range(5)]
    assert scores(ranking.saturate_files(candidates(spark, rows))) == {"c0": 5.0, "c1": 2.0, "c2": 0.75, "c3": 0.25, "c4": 0.0625}
    two = rows + [(0, "q", "s", "d0", "a.py", "", 4.5), (1, "q", "s", "d0", "a.py", "", 0.1)]
    top = ranking.rank_candidates(candidates(spark, two), 2, query_boosts=False).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["chunk_id"]) for r in top] == [(0, "c0"), (0, "d0"), (1, "d0")]  # files of two repositories don't mix


def test_lines_and_chunks(spark):
    chunks = spark.createDataFrame([("big", "r", "a.py", 1, 50), ("small", "r", "a.py", 10, 20)], "chunk_id string, repo_id string, file_path string, start_line int, end_line int")
    places = spark.createDataFrame([(0, "r", "a.py", 15), (1, "r", "a.py", 5), (2, "r", "b.py", 5), (3, "r", "a.py", 60), (4, "r", "a.py", 20)], "place_id int, repo_id string, file_path string, line int")
    assert {r["place_id"]: r["chunk_id"] for r in lookups.chunk_at_line(chunks, places).collect()} == {0: "small", 1: "big", 4: "small"}
    assert {r["place_id"]: r["chunk_id"] for r in lookups.chunk_at_line_inner(chunks, places).collect()} == {0: "big", 1: "big", 4: "big"}


def test_evaluation(spark):
    hits = spark.createDataFrame([(0, 1, 1), (0, 2, 3), (0, 2, 7), (1, 1, 2), (1, 2, 2)], "query_id int, target_id int, rank int")
    totals = spark.createDataFrame([(0, 2), (1, 2), (2, 0), (3, 4)], "query_id int, n_relevant int")
    got = {r["query_id"]: round(r["ndcg"], 6) for r in evaluation.ndcg(hits, totals).collect()}
    assert got == {0: 0.919721, 1: round((1 / np.log2(3)) / (1 + 1 / np.log2(3)), 6), 2: 0.0, 3: 0.0}
    units = spark.createDataFrame([(0, 1, 100), (0, 2, 50), (0, 3, 10)], "query_id int, rank int, n_tokens int")
    curve = evaluation.curves(units, hits.where("query_id = 0"))
    assert [(r["tokens"], r["covered"]) for r in curve.orderBy("rank").collect()] == [(100, 1), (150, 1), (160, 2)]
    recall = evaluation.recall_at_budget(curve, totals, [50, 150, 1000]).where("query_id = 0").orderBy("budget").collect()
    assert [r["recall"] for r in recall] == [0.0, 0.5, 1.0]
    costs = spark.createDataFrame([(0, 1, 100, 1), (2, 1, 40_000, 1)], "query_id int, rank int, tokens int, covered int")
    three = spark.createDataFrame([(0, 1), (1, 1), (2, 1)], "query_id int, n_relevant int")
    assert round(evaluation.expected_cost(costs, three, 32_000).first()["cost"], 2) == 24033.33
    assert evaluation.expected_cost(costs, three.limit(0), 32_000).first()["cost"] == 32_000
    pair = evaluation.paired_reduction(evaluation.first_hit_tokens(costs), evaluation.first_hit_tokens(costs.withColumn("tokens", F.col("tokens") * 2))).first()
    assert (pair["n_paired"], pair["median_reduction"], pair["share_better"]) == (2, 0.5, 1.0)


def test_service(spark):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from stratasearch.sources.config import EmbeddingConfig

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            bad = any("bad" in t for t in asked["input"])
            rows = [{"index": k, "embedding": [3.0, float(len(t)), 0.0, 4.0]} for k, t in enumerate(asked["input"])]
            body = json.dumps({"error": "busy"} if bad else {"data": rows[::-1]}).encode()
            self.send_response(500 if bad else 200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    config = EmbeddingConfig(model="m", dim=4, url=f"http://127.0.0.1:{server.server_port}/", max_retries=1)
    encoder = dense.create_encoder(config)
    encoder.wait = 0.0
    assert encoder.name == "m" and [v.round(3).tolist() for v in encoder.encode(["", ""])] == [[0.6, 0.0, 0.0, 0.8]] * 2
    got = encoder.encode(["a", "bad"])
    assert got[1] is None and np.isclose((got[0] ** 2).sum(), 1)
    wrong = dense.ServiceEncoder(config.url, "m", 5)
    with pytest.raises(dense.PermanentError):
        wrong.encode(["a"])
    with pytest.raises(dense.PermanentError):  # not tried again
        dense.RetryingEncoder(wrong, retries=3, wait=100).encode(["a"])
    server.shutdown()
    with pytest.raises(ValueError):
        dense.create_encoder(EmbeddingConfig(model="m"))


def test_exact_budget(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    words = Tokenizer(models.WordLevel({"[UNK]": 0, "a": 1}, unk_token="[UNK]"))
    words.pre_tokenizer = pre_tokenizers.Whitespace()
    words.save(str(tmp_path / "t.json"))
    count = lambda t: len(t.split())
    assert dense.fitted("aa bb cc", count, 2) == "aa bb " and dense.fitted("aa bb", count, 2) == "aa bb" and dense.fitted("aa", count, 0) == ""
    encoder = dense.ServiceEncoder("http://x", "m", 4, context=40, tokenizer=str(tmp_path / "t.json"))
    assert encoder.cut(["a " * 100, "a"]) == ["a " * encoder.budget, "a"] and encoder.budget == 22


def test_scopes_and_exclusions_in_one_plan(spark):
    rng = np.random.default_rng(5)
    rows = [(f"c{k:03}", f"n{k % 4}", [float(x) for x in rng.standard_normal(6)]) for k in range(300)]
    vectors = spark.createDataFrame(rows, "chunk_id string, namespace string, vector array<double>")
    asked = [(k, [None, f"n{k % 5}"][k % 2], f"n{k % 3}" if k % 3 else None, [float(x) for x in rng.standard_normal(6)]) for k in range(20)]
    queries = spark.createDataFrame([*asked, (99, None, None, None), (98, None, None, [1.0])], "query_id long, only string, without string, vector array<double>")
    got = {}
    for r in dense.batch_nearest(vectors, queries, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    for k, only, without, q in asked:
        fits = [(-round(float(np.dot(v, q)), 9), c) for c, n, v in rows if (only is None or n == only) and (without is None or n != without)]
        assert got.get(k, []) == [c for _, c in sorted(fits)[:4]], k
    assert 99 not in got and 98 not in got


def test_interfaces(spark):
    from stratasearch.plans.interfaces import TableSparseIndex, TableVectorStore

    frame = lambda rows: spark.createDataFrame(rows, "chunk_id string, vector array<double>")
    store = TableVectorStore(spark, 2)
    store.add("one", frame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])]))
    store.add("two", frame([("a", [0.6, 0.8])]))
    assert [(r["chunk_id"], r["namespace"]) for r in store.query_global([1.0, 0.0], 2).orderBy("rank").collect()] == [("a", "one"), ("a", "two")]
    assert [r["chunk_id"] for r in store.query("one", [0.0, 1.0], 1).collect()] == ["b"]
    assert store.query_global([1.0, 0.0], 5, without=["one"]).count() == 1
    store.delete("one", ["a"])
    assert store.query_global([1.0, 0.0], 5).count() == 2
    store.clear("two")
    assert store.query_global([1.0, 0.0], 5).count() == 1
    with pytest.raises(ValueError):
        store.add("one", frame([("c", [1.0])]))
    with pytest.raises(ValueError):
        store.add("one", frame([("b", [1.0, 0.0])]))
    chunks = spark.createDataFrame([("a", "r", "auth.py", "def pass_token"), ("b", "r", "b.py", "other")], "chunk_id string, repo_id string, file_path string, content string")
    index = TableSparseIndex(chunks)
    assert index.doc_count() == 2 and [r["chunk_id"] for r in index.query("token", 5).collect()] == ["a"]
    index.remove(["a"])
    assert index.doc_count() == 1 and index.query("token", 5).count() == 0
    index.add(chunks.where("chunk_id = 'a'"))
    assert index.query("token", 5).count() == 1


def test_annotations(spark, tmp_path):
    from stratasearch.sources import annotations

    (tmp_path / "one.json").write_text('[{"query": "a b", "relevant": ["x.py", {"path": "y.py", "start_line": 1, "end_line": 2}], "secondary": []}]')
    tasks = annotations.load_tasks(spark, str(tmp_path))
    assert [(r["repo"], r["query"], r["category"]) for r in tasks.collect()] == [("one", "a b", "semantic")]
    assert {(r["path"], r["from_line"], r["to_line"]) for r in annotations.task_targets(tasks).collect()} == {("x.py", None, None), ("y.py", 1, 2)}
    (tmp_path / "repos.list").write_text('[{"name": "one", "language": "python", "url": "u", "revision": "r"}]')
    assert annotations.load_repos(spark, str(tmp_path / "repos.list")).first()["language"] == "python"
    path = annotations.save_results(tasks, str(tmp_path / "out"), "hybrid", "0123456789abcdef")
    assert path.endswith("hybrid-0123456789ab.json") and spark.read.json(path, multiLine=True).count() == 1


def test_token_counter(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    from stratasearch.functions.text import token_counter

    made = Tokenizer(models.WordLevel({"a": 0, "b": 1, "[UNK]": 2}, unk_token="[UNK]"))
    made.pre_tokenizer = pre_tokenizers.Whitespace()
    made.save(str(tmp_path / "t.json"))
    rows = spark.createDataFrame([(0, "a b c"), (1, None)], "k int, x string")
    assert [r["n"] for r in rows.select("k", token_counter(str(tmp_path / "t.json"))("x").alias("n")).orderBy("k").collect()] == [3, 0]
    assert rows.where("k = 0").select(token_counter()("x").alias("n")).first()["n"] == 1


def recall_at(rows, x, ids, asked, k=10):
    """The mean share of the k true neighbours (by cosine) among the rows found."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in rows:
        got.setdefault(r["query_id"], set()).add(r["chunk_id"])
    assert all(len(got.get(q, ())) == k for q in asked)
    place = {v: n for n, v in enumerate(ids)}
    true = {q: {ids[n] for n in np.argsort(-(x @ x[place[q]]), kind="stable")[:k]} for q in asked}
    return np.mean([len(got[q] & true[q]) / k for q in asked])


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01", "sf0.1"])
def test_approximate_recall(spark, scale):
    from stratasearch.plans.queries import QUERIES

    rows = QUERIES["lsh_ann"](spark, f"/root/testdata/{scale}").collect()
    table = spark.read.parquet(f"/root/testdata/{scale}/embeddings.parquet").orderBy("vec_id").collect()
    ids = [r["vec_id"] for r in table]
    assert recall_at(rows, np.array([r["embedding"] for r in table]), ids, [k for k in ids if k % 50 == 0]) >= 0.9


def test_approximate_prunes_where_it_can(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.repeat(rng.standard_normal((100, 16)), 20, axis=0) + rng.standard_normal((2000, 16)) * 0.02
    rows = spark.createDataFrame([(k, "n", v.tolist()) for k, v in enumerate(x)], "chunk_id long, namespace string, vector array<double>")
    asked = rows.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    lefts, calibrated = [], dense._calibrated

    def spy(*args):
        lefts.append(calibrated(*args))
        return lefts[-1]

    monkeypatch.setattr(dense, "_calibrated", spy)
    got = dense.approximate_nearest(rows, asked, 10).collect()
    assert recall_at(got, x, list(range(2000)), list(range(0, 2000, 20))) >= 0.9
    assert lefts[0][1] < 0.5
    # far too short a bucket: no candidates but the row itself, so the exact search fills in
    got = dense.approximate_nearest(rows, asked, 10, bucket=1e-6).collect()
    assert recall_at(got, x, list(range(2000)), list(range(0, 2000, 20))) == 1


@pytest.mark.parametrize("bound", [{"MOST_ASKED_BYTES": 200}, {"MOST_BEST_ROWS": 12}, {}])
def test_queries_of_unknown_size_are_dealt_into_passes(spark, monkeypatch, bound):
    for name, value in bound.items():
        monkeypatch.setattr(dense, name, value)
    rng = np.random.default_rng(8)
    rows = [(f"c{k:03}", "n", [float(x) for x in rng.standard_normal(5)]) for k in range(200)]
    stored = spark.createDataFrame(rows, "chunk_id string, namespace string, vector array<double>")
    asked = [(k, [float(x) for x in rng.standard_normal(5)]) for k in range(30)]
    queries = spark.createDataFrame(asked, "query_id long, vector array<double>")
    found = dense.batch_nearest(stored, queries, 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and ("Union" in plan) == bool(bound)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    for k, q in asked:
        assert got[k] == [c for _, c in sorted((-round(float(np.dot(v, q)), 9), c) for c, _, v in rows)[:4]]


def test_passes_keep_their_bounds(spark):
    queries = spark.createDataFrame([(k, [1.0] * 4) for k in range(100)], "query_id long, vector array<double>")
    parts = dense._passes(queries, 3, most_bytes=32 * 20, most_rows=10_000)
    assert sum(n for _, n in parts) == 100 and all(n <= 20 for _, n in parts)
    assert sorted(r["query_id"] for part, _ in parts for r in part.collect()) == list(range(100))
    one = spark.createDataFrame([(1, [1.0] * 4)], "query_id long, vector array<double>")
    assert [n for _, n in dense._passes(one, 3, most_bytes=1, most_rows=1)] == [1] and [n for _, n in dense._passes(one.limit(0), 3)] == [0]
