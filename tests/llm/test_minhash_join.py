"""The similarity join against all pairs."""

import random
import re

import numpy as np
import pytest

from stratasearch.llm import minhash_join

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, words):
    found = WORD.findall((text or "").translate(LOWER))
    if not found:
        return frozenset()
    if len(found) < words:
        return frozenset([tuple(found)])
    return frozenset(tuple(found[k : k + words]) for k in range(len(found) - words + 1))


def brute_force(rows, words, percent):
    """doc_id -> (set size, component)."""
    sets = {d: shingles(t, words) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus(seed, n=150):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["The", "of", "É", "ü"]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.6:
            words = rng.choice(texts[-20:]).split(" ")
            for _ in range(rng.randint(0, max(1, len(words) // 8))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            text = " ".join(words)
            texts.append(text.upper() if rng.random() < 0.2 else text)
        else:
            texts.append(" ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 5, 40, 120]))))
    return list(enumerate(texts, 3))


def found(frame, **options):
    rows = minhash_join.near_duplicates(frame, **options).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}


@pytest.mark.parametrize("words,percent", [(2, 80), (5, 80), (1, 60)])
def test_all_pairs(spark, words, percent):
    rows = corpus(words * 100 + percent)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(frame, words=words, percent=percent, recall=0.99999) == brute_force(rows, words, percent)


def edited(base, rng, most, pool=50):
    words = list(base)
    for _ in range(rng.randint(1, most)):
        words[rng.randrange(len(words))] = f"x{rng.randrange(pool)}"
    return " ".join(words)


def test_large_nodes_are_cut(spark):
    """Nodes of more rows than a block are compared block by block, with the same result."""
    rng = random.Random(8)
    base = [f"w{k}" for k in range(60)]
    rows = [(k, edited(base, rng, 5)) for k in range(80)] + [(100 + k, t) for k, t in corpus(5, 40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (7, 30):
        assert found(frame, words=1, block_rows=block, recall=0.99999) == brute_force(rows, 1, 80)


def test_large_nodes_branch_on(spark):
    rng = random.Random(18)
    rows = [(9 * k + j, edited([f"w{(k + i) % 90}" for i in range(0, 80)], rng, 4)) for k in range(30) for j in range(5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(frame, words=1, branch_rows=20, recall=0.99999) == brute_force(rows, 1, 80)


def test_chains_of_links(spark):
    """Rows whose star fails find their other partners: neighbours in a chain are linked, others are not."""
    rows = [(k, " ".join(f"w{i}" for i in range(6 * k, 6 * k + 100))) for k in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for tries in (1, 4):
        assert found(frame, words=1, tries=tries) == brute_force(rows, 1, 80)


def test_families_are_compared_in_blocks(spark, monkeypatch):
    """Groups with more candidates than are tried go to blocks of few rows, with the same result."""
    rng = random.Random(28)
    base = [f"w{k}" for k in range(60)]
    rows = [(k, edited(base, rng, 9, 400)) for k in range(120)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    real, calls = minhash_join.family_links, []
    monkeypatch.setattr(minhash_join, "family_links", lambda *a: calls.append(1) or real(*a, rows_at_once=16, weight=500))
    assert found(frame, words=1, tries=1) == brute_force(rows, 1, 80) and calls


def test_a_shared_template_makes_no_group(spark):
    """Unrelated texts of similarity 0.57 through a template, with near copies (0.82) planted among them: few pairs are confirmed."""
    rng = random.Random(21)
    template = [f"t{k}" for k in range(146)]
    rows = []
    for k in range(200):
        own = [f"o{k}x{i}" for i in range(54)]
        rows.append((2 * k, " ".join(template + own)))
        rows.append((2 * k + 1, " ".join(template + own[:34] + [f"p{k}x{i}" for i in range(20)])))
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    asked = []
    real = minhash_join.confirmed_links
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(minhash_join, "confirmed_links", lambda pairs, *a: asked.append(pairs.count()) or real(pairs, *a))
        got = found(frame, words=1)
    assert got == brute_force(rows, 1, 80) and len({c for _, c in got.values()}) == 200
    assert sum(asked) < 3000  # of 79,800 pairs


def test_rows_that_repeat_ids(spark):
    one, two = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(5, one, 1), (5, two, 1), (9, one + " x", 1), (9, two, 1), (7, two + " y", 1), (7, two + " y", 1), (8, "", 1), (8, "", 1), (6, one, 1), (6, one + " z", 1), (None, one, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, mark int")
    got = sorted(map(tuple, minhash_join.near_duplicates(frame, words=2).collect()), key=str)
    want = [(d, len(shingles(t, 2)), None if d is None else 8 if not t else 5, d in (5, 8, None)) for d, t, _ in rows]
    assert got == sorted(want, key=str)
    kept = minhash_join.drop_near_duplicates(frame, words=2)
    assert kept.columns == frame.columns
    assert sorted([tuple(r)[:2] for r in kept.collect()], key=str) == sorted([(5, one), (5, two), (8, ""), (None, one)], key=str)


def test_pairs_at_the_threshold_are_found(spark):
    """Recall, measured: pairs of similarity 0.80 to 0.81 in a table where a third of the rows share half of their words."""
    rng = random.Random(33)
    rows = []
    for k in range(1500):
        words = [f"c{i}" for i in range(45)] if k % 3 == 0 else []
        words += [f"u{k}x{i}" for i in range(90 - len(words))]
        other = words[:80] + [f"v{k}x{i}" for i in range(10)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(rng.sample(other, 90)))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = found(frame, words=1)
    assert sum(got[2 * k + 1][1] == 2 * k for k in range(1500)) >= 1499


def test_whole_table(spark, data):
    frame = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in frame.collect()]
    assert found(frame, words=2) == brute_force(rows, 2, 80)


def test_odd_rows(spark):
    long = " ".join(f"w{k % 700}" for k in range(30_000))
    rows = [(1, None, 1), (2, "", 1), (3, " \t ", 1), (4, "One", 1), (5, "one", 1), (5, "one", 1), (6, long, 1), (7, long + " end", 1), (None, "one", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, rep int")
    got = sorted(map(tuple, minhash_join.near_duplicates(frame, words=2).collect()), key=str)
    n = len(shingles(long, 2))
    want = [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (5, 1, 4, False), (6, n, 6, True), (7, n + 1, 6, False), (None, 1, None, True)]
    assert got == sorted(want, key=str)
    kept = minhash_join.drop_near_duplicates(frame, words=2)
    assert kept.columns == frame.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "4", "6", "None"]
    assert minhash_join.near_duplicates(frame.limit(0)).count() == 0


def test_plan_follows_size():
    levels = [minhash_join.plan_levels(n) for n in (10, 10**5, 10**8, 10**11)]
    trees = [minhash_join.plan_trees(x, 0.8, 0.998) for x in levels]
    assert trees == sorted(trees) and levels == sorted(levels)


def test_codes_agree_as_often_as_sets_do():
    rng = np.random.default_rng(4)
    one = rng.integers(0, 2**64, 400, dtype=np.uint64)
    for shared in (360, 356, 200):  # of 400 each: similarities 0.82, 0.80 and 0.33
        two = np.concatenate([one[:shared], rng.integers(0, 2**64, 400 - shared, dtype=np.uint64)])
        paths, codes, _, _ = minhash_join.signatures(np.concatenate([np.sort(one), np.sort(two)]), np.array([400, 400]))
        alike = shared / (800 - shared)
        apart = minhash_join._disagreements(codes[0], codes[1]) / minhash_join.CODE_PLACES
        assert abs((1 - apart) - (alike + (1 - alike) / 4)) < 0.1
        assert abs((paths[0] == paths[1]).mean() - alike) < 0.15
