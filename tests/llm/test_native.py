"""Exact dedup and url rules against direct versions."""

import hashlib
import random

import pytest

from stratasearch.llm import exact_dedup, url_rules

LOWER = {c: c + 32 for c in range(65, 91)}


def copies(rows):
    groups = {}
    for doc, text in rows:
        key = hashlib.sha256((text or "").translate(LOWER).encode()).hexdigest()
        groups.setdefault(key, []).append(doc)
    out = []
    for key, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        out += [(i, keep, len(ids), i == keep, key) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("counters", [8, 1024])
def test_exact_dedup(spark, counters):
    rng = random.Random(4)
    rows = [(k, rng.choice(["Aa", "aA", "É", "é", "", None, "b" * 5000]) if k % 3 else f"t{rng.randrange(300)}") for k in range(900)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert sorted(map(tuple, exact_dedup.mark_copies(frame, counters).collect()), key=str) == copies(rows)


def test_exact_dedup_odd_rows(spark):
    rows = [(1, None, 1), (2, "", 1), (None, "x", 1), (3, "y", 1), (3, "y", 1), (None, "z", 1), (4, "Z", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, digest int")
    assert sorted(map(tuple, exact_dedup.mark_copies(frame).collect()), key=str) == copies([r[:2] for r in rows])
    kept = exact_dedup.drop_copies(frame)
    assert kept.columns == frame.columns and 1 not in {r["doc_id"] for r in kept.collect()}
    assert exact_dedup.mark_copies(frame.limit(0)).count() == 0


def test_drop_copies_where_ids_repeat(spark):
    rows = [(3, "y", 1), (3, "Y", 1), (5, "alone", 1), (5, "copy", 1), (6, "Copy", 1), (7, "z", 1), (None, "n", 1), (None, "n", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, digest_0 int")
    kept = exact_dedup.drop_copies(frame)
    assert kept.columns == frame.columns
    got = sorted([(r["doc_id"], r["text"].lower()) for r in kept.collect()], key=str)
    assert got == sorted([(3, "y"), (5, "alone"), (6, "copy"), (7, "z"), (None, "n"), (None, "n")], key=str)


def host_and_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[end:]
    stop = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return rest[:end].translate(LOWER), path[:stop]


def judged(rows, rules, default="allow"):
    out = []
    for page, url in rows:
        host, path = host_and_path(url)
        fits = [(len(h + p), h, p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        out.append((page, host, path, best[1] + best[2] if best else None, best[3] if best else default))
    return sorted(out, key=str)


@pytest.mark.parametrize("sweep_rows", [3, 50_000])
def test_url_rules(spark, sweep_rows):
    rng = random.Random(6)
    hosts = ["org", "a.org", "b.a.org", "c.b.a.org", "xa.org", "com", "a.com"]
    starts = ["/", "/x", "/x/", "/x/y", "/xy", "", "/z"]
    rules = list({(rng.choice(hosts), rng.choice(starts)): rng.choice(["allow", "block"]) for _ in range(18)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    tails = ["", "?q=/x", "#/x", "/x?y", "/x/y/z", "/xyz", "/x/#", "/z/x", "//x"]
    rows = [(k, f"https://{rng.choice(['', 'W.', 'n.'])}{rng.choice(hosts)}{rng.choice(tails)}") for k in range(400)]
    frame = spark.createDataFrame(rows, "page_id long, url string")
    ruled = url_rules.rules_frame(spark, tuple(rules))
    got = sorted(map(tuple, url_rules.judge_urls(frame, ruled, sweep_rows=sweep_rows).collect()), key=str)
    assert got == judged(rows, rules)


def test_url_rules_odd_rows(spark):
    rows = [
        (1, None), (2, ""), (3, "no scheme.org/"), (4, "://org/es"), (None, "http://example.org/es/x"), (5, "HTTP://A.EXAMPLE.ORG/es/"), (5, "HTTP://A.EXAMPLE.ORG/es/"),
        (6, "x://" + "a." * 3000 + "org/" + "y" * 5000), (7, "http://.org/"), (8, "http://example.org:80/es/"), (9, "http:///path"), (10, "a://b://org/"),
    ]
    frame = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 AS host", "2 AS stack")
    rules = url_rules.DEFAULT_RULES
    got = sorted(map(tuple, url_rules.judge_urls(frame, url_rules.rules_frame(spark)).collect()), key=str)
    assert got == judged(rows, rules)
    assert url_rules.judge_urls(frame.limit(0), url_rules.rules_frame(spark)).count() == 0
    none = spark.createDataFrame([], "rule_host string, rule_path string, verdict string")
    assert {r["verdict"] for r in url_rules.judge_urls(frame, none, "block").collect()} == {"block"}


def test_only_built_in_functions(spark, data):
    """No Python in the plans of the native operators."""
    documents, pages = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "pages"))
    for frame in (exact_dedup.mark_copies(documents), url_rules.judge_urls(pages, url_rules.rules_frame(spark))):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct"))
