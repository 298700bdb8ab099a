"""Near-duplicate vectors against all pairs."""

import math

import numpy as np

from stratasearch.llm import embedding_dedup


def brute_force(rows, threshold=0.95):
    unit = {}
    for k, v in rows:
        if k is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v):
            a = np.array(v, dtype=np.float64)
            unit[k] = a / np.linalg.norm(a)
    parent = {k: k for k, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = dict.fromkeys(parent, 0)
    ids = sorted(unit)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= threshold:
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {k: (links[k], find(k)) for k in parent}


def found(frame, **options):
    rows = embedding_dedup.near_duplicate_vectors(frame, **options).collect()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in rows)
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows}


def sample(n_groups=25, dim=16, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n_groups):
        centre = rng.standard_normal(dim)
        for _ in range(rng.integers(1, 9)):
            rows.append(centre * rng.uniform(0.5, 2) + rng.standard_normal(dim) * rng.choice([0, 0.01, 0.2]))
    rng.shuffle(rows)
    return [(k, [float(np.float32(x)) for x in v]) for k, v in enumerate(rows)]


def test_all_pairs(spark):
    rows = sample()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute_force(rows)
    for window, block in ((128, 4096), (4, 5)):
        assert found(frame, window=window, block_rows=block, recall=0.9999) == want


def test_group_larger_than_the_window(spark):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(8)
    rows = [(k, [float(x) for x in centre + rng.standard_normal(8) * 0.02]) for k in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(frame, window=8, block_rows=64) == {k: (299, 0) for k in range(300)}


def test_whole_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    assert found(frame) == brute_force([(r["vec_id"], r["embedding"]) for r in frame.collect()])


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [2.0, 0.0], 1), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [None, 1.0], 1),
        (9, [], 1), (10, [1.0, 0.0, 0.0], 1), (11, [-1.0, 0.0], 1), (12, [1e300, 1e299], 1), (13, [1e-300, 1e-301], 1), (None, [1.0, 0.0], 1),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, vector int")
    got = found(frame)
    assert got.pop(None) == (0, None)
    assert got == {1: (4, 1), 2: (4, 1), 3: (4, 1), 4: (0, 4), 5: (0, 5), 6: (0, 6), 7: (0, 7), 8: (0, 8), 9: (0, 9), 10: (0, 10), 11: (0, 11), 12: (4, 1), 13: (4, 1)}
    assert embedding_dedup.near_duplicate_vectors(frame.limit(0)).count() == 0


def test_passes_follow_size():
    needed = [embedding_dedup.passes_needed(n, 128, 0.95, 0.998) for n in (10, 10**4, 10**6, 10**9)]
    assert needed == sorted(needed) and needed[0] >= 2


def crowd(n_crowd, n_pairs, cosine, dim=64, seed=11):
    """Unlinked vectors of one cone, and ``n_pairs`` partners just above the threshold, in the same cone."""
    rng = np.random.default_rng(seed)
    axis = np.zeros(dim)
    axis[0] = 1

    def residuals(n):
        r = rng.standard_normal((n, dim))
        r[:, 0] = 0
        return r / np.linalg.norm(r, axis=1, keepdims=True)

    r = residuals(n_crowd)
    other = residuals(n_pairs)
    other -= (other * r[:n_pairs]).sum(axis=1, keepdims=True) * r[:n_pairs]
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    inner = (0.952 - cosine) / (1 - cosine)
    near = inner * r[:n_pairs] + math.sqrt(1 - inner * inner) * other
    return math.sqrt(cosine) * axis + math.sqrt(1 - cosine) * np.concatenate([r, near])


def test_crowded_vectors(spark):
    x = crowd(8000, 300, 0.88)
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = found(frame)
    links = np.concatenate([(x[k : k + 1000] @ x.T >= 0.95).sum(axis=1) - 1 for k in range(0, len(x), 1000)])
    assert [got[k][0] for k in range(len(x))] == links.tolist()


def test_crowded_vectors_in_passes(spark, monkeypatch):
    x = crowd(3000, 300, 0.8)
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(embedding_dedup, "best_bits", lambda *a: 6)
    monkeypatch.setattr(embedding_dedup, "HELD", 100)
    got = found(frame, block_rows=200)
    assert all(got[3000 + k][1] <= k for k in range(300))


def test_partitions_cut_nothing(spark):
    spread = np.random.default_rng(3).standard_normal((1500, 64))
    x = np.concatenate([crowd(300, 150, 0.85), spread / np.linalg.norm(spread, axis=1, keepdims=True)])
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    links = ((x @ x.T >= 0.95).sum(axis=1) - 1).tolist()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for number in ("1", "8", "300"):
            spark.conf.set("spark.sql.shuffle.partitions", number)
            got = found(frame)
            assert [got[k][0] for k in range(len(x))] == links, number
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_pairs_in_doubt_are_confirmed(spark):
    """Cosines a hair's breadth beside the threshold, closer than codes can tell."""
    rng = np.random.default_rng(17)
    rows = []
    for k in range(400):
        a, b = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
        cosine = 0.95 + (1e-9 if k % 2 else -1e-9) * rng.integers(1, 5000)
        rows += [a, cosine * a + math.sqrt(1 - cosine * cosine) * b]
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)], "vec_id long, embedding array<double>")
    got = found(frame)
    assert [got[2 * k + 1] for k in range(400)] == [(1, 2 * k) if k % 2 else (0, 2 * k + 1) for k in range(400)]


def test_codes_bound_the_cosine():
    rng = np.random.default_rng(19)
    x = embedding_dedup.unit(rng.standard_normal((300, 48)) * rng.choice([1e-3, 1, 50], (300, 48)))
    y, off = embedding_dedup.decoded(embedding_dedup.codes(x), 48)
    room = off[:, None] + off[None, :] + off[:, None] * off[None, :]
    assert (np.abs(x @ x.T - y @ y.T) <= room).all() and room.max() < 1e-3


def test_second_hash_is_one_of_its_own(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([([float(k), 1.0],) for k in range(50)], "v array<double>")
    pair = rows.select(F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(7), "v").alias("h2"), F.xxhash64("v", F.lit(7)).alias("of_h1"))
    assert pair.where("h2 = of_h1 OR h1 = h2").count() == 0


def sorted_rows(n, window, runs, seed=23, dim=32, ranges=(1,)):
    """All pairs that ``_windows`` must compare: rows at most ``window`` apart, and rows of one run; and those that it finds."""
    import pyarrow as pa

    rng = np.random.default_rng(seed)
    x = embedding_dedup.unit(rng.standard_normal((1, dim)) + 0.35 * rng.standard_normal((n, dim)))
    run_of = np.sort(rng.integers(0, runs, n))
    group = np.repeat([0, 1], [n // 3, n - n // 3])
    order = np.lexsort((run_of, group))
    run_of, group = run_of[order], group[order]
    near = (np.arange(n)[None, :] - np.arange(n)[:, None] <= window) | (run_of[None, :] == run_of[:, None])
    want = (x @ x.T >= 0.95) & near & (group[None, :] == group[:, None]) & np.triu(np.ones((n, n), bool), 1)
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    columns = [group, np.full(n, dim), run_of, np.arange(n), np.arange(n)]
    batch = pa.RecordBatch.from_arrays(
        [*[pa.array(c, k) for c, k in zip(columns, kinds)], pa.array(embedding_dedup.codes(x), pa.binary())], names=["pass", "dim", "run", "key", "rep", "code"]
    )
    return x, want, batch


def united(n, pairs):
    from stratasearch.llm.components import Forest

    forest = Forest(n)
    for a, b in pairs:
        forest.union(a, b)
    return [forest.find(k) for k in range(n)]


def test_windows_meet_across_keys_and_batches(monkeypatch):
    """Neighbours with different keys meet; however the rows come in batches, the same components follow."""
    n, window = 500, 12
    for runs in (400, 20, 3):
        x, want, batch = sorted_rows(n, window, runs)
        for step, held, tile in ((500, 8192, 256), (17, 40, 7), (1, 13, 1)):
            monkeypatch.setattr(embedding_dedup, "TASK_ROWS", held)
            monkeypatch.setattr(embedding_dedup, "TILE_ROWS", tile)
            parts = [batch.slice(k, step) for k in range(0, n, step)]
            links, borders = [], []
            for out in embedding_dedup._windows(0.95, window, True)(iter(parts)):
                rows = out.to_pylist()
                links += [(r["a"], r["b"], r["sure"]) for r in rows if r["a"] is not None]
                borders += [r["rep"] for r in rows if r["rep"] is not None]
            assert sorted(borders) == [*range(window), *range(n - window, n)]
            assert all(x[a] @ x[b] >= 0.949 for a, b, sure in links if not sure)
            made = [(a, b) for a, b, sure in links if sure or x[a] @ x[b] >= 0.95]
            assert united(n, made) == united(n, np.argwhere(want).tolist())


def test_borders_of_ranges_lose_no_neighbours(spark, monkeypatch):
    """With one pass, no runs and many ranges, what the windows find doesn't depend on the ranges."""
    monkeypatch.setattr(embedding_dedup, "passes_needed", lambda *a: 1)
    monkeypatch.setattr(embedding_dedup, "best_bits", lambda *a: embedding_dedup.SIGNS)
    rng = np.random.default_rng(29)
    centres = rng.standard_normal((150, 16))
    x = np.concatenate([centres + 0.08 * rng.standard_normal((150, 16)) for _ in range(4)])
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for number in ("1", "12"):
            spark.conf.set("spark.sql.shuffle.partitions", number)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            seen.append(found(frame, window=8))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert seen[0] == seen[1]
    assert sum(c != k for k, (_, c) in seen[0].items()) > 200


def test_recall_at_the_threshold(spark):
    """Planted pairs just above 0.95 among others."""
    rng = np.random.default_rng(31)
    a = embedding_dedup.unit(rng.standard_normal((2000, 64)))
    other = rng.standard_normal((2000, 64))
    other = embedding_dedup.unit(other - (other * a).sum(axis=1, keepdims=True) * a)
    b = 0.9502 * a + math.sqrt(1 - 0.9502**2) * other
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(np.concatenate([a, b]))], "vec_id long, embedding array<double>")
    got = found(frame)
    assert sum(got[2000 + k] == (1, k) for k in range(2000)) >= 1990
