"""Near-duplicate vectors by sorted projection passes.

Each pass orders the vectors by a key, the concatenated signs of their products with random directions, and compares each with the
``window`` vectors behind it, whatever their keys. The order is made by one range exchange; the first and last rows of each range are handed on and
compared with their neighbours beyond its border, in fewer ranges each time until there is one. Links are united across passes.

A window alone would lose pairs where many keys begin alike. So all vectors of a run, whose keys agree in the first signs, are compared as well: borders of
ranges lie between runs, a run that is longer than the window is compared whole, and one of more than ``block_rows`` rows is cut into blocks,
each compared with each. A pair at the threshold shares a run with a probability that depends on its angle and the number of signs only,
so the number of passes for the target recall follows from the number of signs; windows only add to it. How many signs are best depends on how
crowded the vectors are, which is measured on a sample.

What a pass moves is an id and a short code, the vector in whole numbers of 16 bits. Codes bound the cosine to about 0.0001: pairs that
are surely linked are united where they meet, and the few in doubt are confirmed on the vectors themselves.

The number of direct links is counted afterwards, exactly, inside each component: block against block, as sums, without a row
per pair. Equal vectors are one class throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_up_to, materialize, partitions
from .components import connected_components, star_edges

SIGNS = 62
#: Signs of a key, at least: no table is compared as a whole.
LEAST_SIGNS = 4
#: Taking a row through a pass costs about as much as comparing it with so many windows.
ROW_WINDOWS = 16
#: Rows whose keys tell how crowded the vectors are, and passes for that, with directions of their own.
SAMPLE_ROWS, SAMPLE_PASSES = 10_000, range(1_000_000, 1_000_003)
#: What single precision adds to the error of a product of codes, for each component.
ROUNDING = 2e-7
#: Pairs in doubt that a task holds at once.
HELD = 1 << 20
#: Sorted rows that a task gathers before it compares them, and rows that are compared at once.
TASK_ROWS, TILE_ROWS = 8192, 256
#: What ranges hand on, 2 * window rows each, is dealt into so many times fewer ranges.
FEWER_RANGES = 16
#: Runs of several blocks that are broadcast; beyond that they are joined by a shuffle.
MOST_LARGE_RUNS = 200_000


def directions(dim: int, number: int) -> np.ndarray:
    """The random directions of a pass; the same in every process."""
    return np.random.default_rng([number, dim, 20011]).standard_normal((dim, SIGNS))


def passes_needed(n: int, window: int, threshold: float, recall: float, bits: int | None = None) -> int:
    """Passes after which a pair at the threshold has agreed in ``bits`` signs at once with the probability ``recall``.

    Without ``bits``, as many signs as leave ``window`` of ``n`` vectors together where each sign halves them.
    """
    signs = max(1.0, math.log2(max(n, 2) / window) + 1) if bits is None else bits
    alike = min(1 - math.acos(threshold) / math.pi, 1 - 1e-6) ** signs
    return max(2, math.ceil(math.log(1 - recall) / math.log1p(-alike)))


def sharing(keys: np.ndarray) -> np.ndarray:
    """The share of pairs of rows that agree in the first 0, 1, ... SIGNS signs of their keys (dim, key)."""
    most = max(1, len(keys) * (len(keys) - 1))
    out = []
    for bits in range(SIGNS + 1):
        _, count = np.unique(np.stack([keys[:, 0], keys[:, 1] >> (SIGNS - bits)]), axis=1, return_counts=True)
        out.append(float((count * (count - 1)).sum()) / most)
    return np.array(out)


def best_bits(n: int, window: int, threshold: float, recall: float, block_rows: int, shared: np.ndarray) -> int:
    """The number of signs with the least work, given the share of pairs that agree in so many signs. The recall is the same for all."""

    def work(bits: int) -> float:
        group = n * shared[bits]
        return passes_needed(n, window, threshold, recall, bits) * (ROW_WINDOWS * window * (1 + group / block_rows) + group / 2)

    return min(range(LEAST_SIGNS, SIGNS + 1), key=work)


def _stacked(column: pa.Array, kind: str) -> np.ndarray:
    """Vectors of one length, kept as bytes, as a matrix in double precision."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1).astype(np.float64)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision, without overflow."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _packed(kind: str):
    """(rep, size, vector) as (rep, size, dim, vector) with the vector as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [np.array(x, dtype=kind).tobytes() for x in batch.column(2).to_pylist()]
            width = np.dtype(kind).itemsize
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(d) // width for d in data], pa.int32()), pa.array(data, pa.binary())],
                names=["rep", "size", "dim", "vector"],
            )

    return run


def codes(x: np.ndarray) -> list[bytes]:
    """Unit vectors in whole numbers of 16 bits, behind the length of one step (a double)."""
    step = np.abs(x).max(axis=1) / 32767
    whole = np.rint(x / step[:, None]).astype("<i2")
    return [a.tobytes() + b.tobytes() for a, b in zip(step, whole)]


def decoded(rows: list[bytes], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of codes, in single precision, and how far each is from its own at most."""
    raw = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), 8 + 2 * dim)
    step = np.ascontiguousarray(raw[:, :8]).view("<f8")[:, 0]
    whole = np.ascontiguousarray(raw[:, 8:]).view("<i2")
    return (whole * step[:, None]).astype(np.float32), step / 2 * math.sqrt(dim) + ROUNDING * dim


def _keyed(numbers: list[int], bits: int, kind: str):
    """Rows (rep, dim, vector) once for each pass, with their key, its first ``bits`` signs as ``run``, and their codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = np.int64(1) << np.arange(SIGNS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            dims = batch.column(1).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                x = unit(_stacked(part.column(2), kind))
                short = pa.array(codes(x), pa.binary())
                for number in numbers:
                    key = (((x @ directions(dim, number)) > 0) @ powers).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(x), number, np.int32)), part.column(1), pa.array(key >> (SIGNS - bits)), pa.array(key), part.column(0), short],
                        names=["pass", "dim", "run", "key", "rep", "code"],
                    )

    return run


def _ends(rows: np.ndarray) -> np.ndarray:
    """For each row, where the run of equal rows that it is in ends."""
    change = np.flatnonzero((rows[1:] != rows[:-1]).any(axis=1)) + 1
    ends = np.append(change, len(rows))
    return np.repeat(ends, np.diff(np.concatenate([[0], ends])))


def _tile_links(ids: np.ndarray, x: np.ndarray, off: np.ndarray, tile: int, reach: np.ndarray, threshold: float):
    """Links between the first ``tile`` rows and the rows behind each up to its ``reach``: edges that stand for the sure ones, and pairs in doubt."""
    score = x[:tile] @ x.T - np.float32(threshold)
    room = (off[:tile, None] + off[None, :] + off[:tile, None] * off[None, :]).astype(np.float32)
    place = np.arange(len(x))
    met = (score >= -room) & (place[None, :] > place[:tile, None]) & (place[None, :] < reach[:, None]) & (ids[None, :] != ids[:tile, None])
    i, j = np.nonzero(met)
    sure = score[i, j] >= room[i, j]
    u, v = star_edges(place, i[sure], j[sure])
    label = place.copy()
    label[u] = v
    apart = ~sure & (label[i] != label[j])
    return ids[u], ids[v], ids[i[apart]], ids[j[apart]]


def _windows(threshold: float, window: int, hand_on: bool):
    """Links of sorted rows (pass, dim, run, key, rep, code) as (a, b, sure), each row with the ``window`` rows behind it and with all of its run.

    With ``hand_on`` the first and last ``window`` rows of the task come out as well, with null a and b. A task holds TASK_ROWS rows and one run.
    """
    names = ["pass", "dim", "run", "key", "rep"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def links(a: np.ndarray, b: np.ndarray, sure: bool) -> pa.RecordBatch:
        nulls = [pa.nulls(len(a), k) for k in (*kinds, pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), sure)), *nulls], names=["a", "b", "sure", *names, "code"])

    def border(rows: np.ndarray, short: list[bytes]) -> pa.RecordBatch:
        nulls = [pa.nulls(len(rows), k) for k in (pa.int64(), pa.int64(), pa.bool_())]
        own = [pa.array(rows[:, k], kind) for k, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([*nulls, *own, pa.array(short, pa.binary())], names=["a", "b", "sure", *names, "code"])

    def compared(rows: np.ndarray, short: list[bytes], last: bool) -> tuple[int, list[pa.RecordBatch]]:
        """Handle the rows whose windows and runs are complete; how many that are."""
        n = len(rows)
        run_end, group_end = _ends(rows[:, :3]), _ends(rows[:, :2])
        reach = np.minimum(group_end, np.maximum(np.arange(n) + 1 + window, run_end))
        ready = n if last else max(0, min(n - window, int(np.flatnonzero(run_end == n)[0])))
        out, at = [], 0
        while at < ready:
            end = min(at + TILE_ROWS, ready, int(group_end[at]))
            upto = int(reach[end - 1])
            x, off = decoded(short[at:upto], int(rows[at, 1]))
            a, b, c, d = _tile_links(rows[at:upto, 4], x, off, end - at, reach[at:end] - at, threshold)
            out += [links(a, b, True), links(np.minimum(c, d), np.maximum(c, d), False)]
            at = end
        return ready, out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, short, seen = np.zeros((0, 5), np.int64), [], 0
        tail, tail_codes = rows, []
        for batch in batches:
            new = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5)], axis=1)
            code = batch.column(5).to_pylist()
            if hand_on:
                head = max(0, window - seen)
                if head:
                    yield border(new[:head], code[:head])
                tail, tail_codes = np.concatenate([tail, new[head:]])[-window:], [*tail_codes, *code[head:]][-window:]
            seen += len(new)
            rows, short = np.concatenate([rows, new]), short + code
            if len(rows) >= TASK_ROWS:
                done, found = compared(rows, short, last=False)
                yield from found
                rows, short = rows[done:], short[done:]
        if len(rows):
            yield from compared(rows, short, last=True)[1]
        if len(tail):
            yield border(tail, tail_codes)

    return run


def _group_links(threshold: float):
    """Links inside each run of rows (pass, dim, run, low, high, left, rep, code), sorted by the first five: between the blocks
    ``low`` and ``high`` of the run, or inside the one block. Few edges (a, b, sure) with the same components stand for all sure links; pairs in
    doubt come as they are, but for those that sure links connect."""

    def batch_of(a: np.ndarray, b: np.ndarray, sure: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.full(len(a), sure))], names=["a", "b", "sure"])

    def close(dim: int, lefts: list, ids: list, rows: list) -> Iterator[pa.RecordBatch]:
        left, ids = np.concatenate(lefts), np.concatenate(ids)
        x, off = decoded(rows, dim)
        inside = left.all()
        asks = np.flatnonzero(left)
        others = asks if inside else np.flatnonzero(~left)
        label = np.arange(len(ids))
        doubt: list[np.ndarray] = []
        for k in range(0, len(asks), 256):
            who, met = asks[k : k + 256], others[k:] if inside else others
            apart = label[who][:, None] != label[met][None, :]  # what is united needs no more links
            score = x[who] @ x[met].T - np.float32(threshold)
            room = (off[who][:, None] + off[met][None, :] + off[who][:, None] * off[met][None, :]).astype(np.float32)
            i, j = np.nonzero((score >= -room) & apart)
            sure = score[i, j] >= room[i, j]
            pairs = np.stack([who[i], met[j]])[:, ~sure]
            doubt.append(pairs[:, pairs[0] != pairs[1]])
            if sure.any():
                u, v = star_edges(np.arange(len(ids)), label[who[i[sure]]], label[met[j[sure]]])
                to = np.arange(len(ids))
                to[u] = v
                label = to[label]
            if sum(d.shape[1] for d in doubt) > HELD:
                i, j = np.concatenate(doubt, axis=1)
                some = label[i] != label[j]
                yield batch_of(ids[i[some]], ids[j[some]], False)
                doubt = []
        if doubt:
            i, j = np.concatenate(doubt, axis=1)
            some = label[i] != label[j]
            yield batch_of(np.minimum(ids[i], ids[j])[some], np.maximum(ids[i], ids[j])[some], False)
        member = np.flatnonzero(label != np.arange(len(ids)))
        yield batch_of(ids[member], ids[label[member]], True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, rows = None, ([], [], [])
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5)], axis=1)
            left, ids = (batch.column(k).to_numpy(zero_copy_only=False) for k in (5, 6))
            starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])) if len(keys) else []
            for a, b in zip(starts, [*starts[1:], len(keys)]):
                if tuple(keys[a].tolist()) != name:
                    if name is not None:
                        yield from close(name[1], *rows)
                    name, rows = tuple(keys[a].tolist()), ([], [], [])
                rows[0].append(left[a:b].astype(bool))
                rows[1].append(ids[a:b])
                rows[2].extend(batch.column(7).slice(a, b - a).to_pylist())
        if name is not None:
            yield from close(name[1], *rows)

    return run


def _confirmed(threshold: float, kind: str):
    """Pairs (a, b, left, right) with the vectors as bytes that reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = np.array([len(v) for v in batch.column(2).to_pylist()])
            for size in np.unique(width):
                part = batch.filter(pa.array(width == size))
                score = (unit(_stacked(part.column(2), kind)) * unit(_stacked(part.column(3), kind))).sum(axis=1)
                yield part.select(["a", "b"]).filter(pa.array(score >= threshold))

    return run


def _block_counts(threshold: float, kind: str):
    """Rows (block, asks, rep, size, vector), sorted by block: for each row that asks, the vectors of the block linked with it."""

    def close(asks: list, reps: list, sizes: list, vectors: list) -> pa.RecordBatch:
        x = unit(np.frombuffer(b"".join(vectors), dtype=kind).reshape(len(reps), -1).astype(np.float64))
        ask = np.array(asks, dtype=bool)
        weight = np.where(ask, 0, np.array(sizes, dtype=np.int64))
        members = np.flatnonzero(~ask)
        who = np.flatnonzero(ask)
        total = np.zeros(len(who), dtype=np.int64)
        for k in range(0, len(who), 512):
            for m in range(0, len(members), 4096):
                some = members[m : m + 4096]
                total[k : k + 512] += (x[who[k : k + 512]] @ x[some].T >= threshold) @ weight[some]
        return pa.RecordBatch.from_arrays([pa.array(np.array(reps, np.int64)[who]), pa.array(total)], names=["rep", "linked"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, rows = None, ([], [], [], [])
        for batch in batches:
            for block, ask, rep, size, vector in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if block != name:
                    if rows[0]:
                        yield close(*rows)
                    name, rows = block, ([], [], [], [])
                for column, value in zip(rows, (ask, rep, size, vector)):
                    column.append(value)
        if rows[0]:
            yield close(*rows)

    return run


def near_duplicate_vectors(
    embeddings: DataFrame,
    threshold: float = 0.95,
    window: int = 128,
    recall: float = 0.9999,
    block_rows: int = 4096,
    passes_at_once: int = 4,
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors are linked when their cosine, in double precision, is at least ``threshold``; ``n_links`` counts the other vectors linked
    directly, equal ones included. ``component_id`` is the least vec_id that links reach, itself included; ``kept`` says whether it
    is the vector's own. No link below the threshold is made; components are found with the probability ``recall`` or more for each
    pair at the threshold, however crowded the vectors are, and all links inside a component are counted. ``window`` is the number of rows behind
    each that it is compared with in a pass; longer runs of keys that begin alike are compared whole, in blocks of ``block_rows``.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, as do vectors of different lengths with
    each other. A null vec_id links with nothing, has a null component and is kept. vec_id is taken for a key. An empty table gives
    an empty result; other columns, whatever their names, are ignored.
    """
    keyed_kind = "pass int, dim int, run long, key long, rep long, code binary"
    found_kind = f"a long, b long, sure boolean, {keyed_kind}"
    single = embeddings.schema["embedding"].dataType.elementType.simpleString() == "float"
    kind = "<f4" if single else "<f8"
    wide = F.col("embedding").cast("array<float>" if single else "array<double>")
    usable = (
        F.col("vec_id").isNotNull()
        & F.coalesce(F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
        & F.coalesce(F.exists(wide, lambda x: x != 0), F.lit(False))
    )
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.when(usable, wide).alias("vector")
    ).select("vec_id", "vector", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(7), "vector").alias("h2"))
    classes = materialize(
        rows.where("vector IS NOT NULL")
        .groupBy("h1", "h2")
        .agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size"), F.first("vector").alias("vector"))
        .select("rep", "size", "vector")
        .mapInArrow(_packed(kind), "rep long, size long, dim int, vector binary")
    )
    n = classes.count()
    some = classes.select("rep", "dim", "vector").where(F.pmod(F.xxhash64("rep"), F.lit(max(1, n // SAMPLE_ROWS))) == 0)
    keys = some.mapInArrow(_keyed(list(SAMPLE_PASSES), SIGNS, kind), keyed_kind).select("pass", "dim", "key").toPandas().to_numpy()
    shared = np.mean([sharing(keys[keys[:, 0] == p, 1:]) for p in SAMPLE_PASSES], axis=0)
    bits = best_bits(n, window, threshold, recall, block_rows, shared)
    numbers = list(range(passes_needed(n, window, threshold, recall, bits)))
    edges = None
    for k in range(0, len(numbers), passes_at_once):
        keyed = classes.select("rep", "dim", "vector").mapInArrow(_keyed(numbers[k : k + passes_at_once], bits, kind), keyed_kind)
        group = ["pass", "dim", "run"]
        large = keyed.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("cut")).where("cut > 1")
        placed = keyed.join(broadcast_up_to(materialize(large), MOST_LARGE_RUNS), group, "left")
        found = []
        ordinary = placed.where("cut IS NULL").drop("cut")
        ranges = partitions(embeddings.sparkSession)
        ordered = ordinary.repartitionByRange(*group)
        while ranges:  # all rows, then what their ranges hand on, in ever fewer ranges
            hand_on = _windows(threshold, window, ranges > 1)
            out = materialize(ordered.sortWithinPartitions(*group, "key", "rep").mapInArrow(hand_on, found_kind))
            found.append(out.where("a IS NOT NULL").select("a", "b", "sure"))
            ranges = 0 if ranges == 1 else max(1, ranges // FEWER_RANGES)
            ordered = out.where("rep IS NOT NULL").select(*keyed.columns).repartitionByRange(max(1, ranges), *group)
        blocks = placed.where("cut IS NOT NULL").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("cut")).cast("int"))
        blocks = blocks.withColumn("other", F.explode(F.expr("sequence(0, cut - 1)")))
        order = [*group, "low", "high"]
        dealt = blocks.select(
            *group, F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), (F.col("part") <= F.col("other")).alias("left"), "rep", "code"
        )
        dealt = dealt.repartition(*order).sortWithinPartitions(*order)
        found.append(dealt.mapInArrow(_group_links(threshold), "a long, b long, sure boolean"))
        found = materialize(reduce(DataFrame.unionByName, found).distinct())
        edges = found if edges is None else edges.unionByName(found)
    doubt = edges.where("NOT sure").select("a", "b").distinct()
    of = classes.select(F.col("rep").alias("a"), F.col("vector").alias("left"))
    and_ = classes.select(F.col("rep").alias("b"), F.col("vector").alias("right"))
    confirmed = doubt.join(of, "a").join(and_, "b").select("a", "b", "left", "right").mapInArrow(_confirmed(threshold, kind), "a long, b long")
    edges = edges.where("sure").select("a", "b").unionByName(confirmed)
    groups = materialize(connected_components(edges).select(F.col("id").alias("rep"), "component"))

    members = groups.join(classes, "rep")
    blocks = members.groupBy("component").agg((F.count(F.lit(1)) / F.lit(block_rows) + 1).cast("int").alias("blocks"))
    placed = members.join(blocks, "component").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    name = F.concat_ws(":", "component", "asked", "part")
    every = F.expr("sequence(0, blocks - 1)")
    asking = placed.withColumn("asked", F.col("part")).withColumn("part", F.explode(every)).withColumn("asks", F.lit(True))
    asked = placed.withColumn("asked", F.explode(every)).withColumn("asks", F.lit(False))
    dealt = asking.unionByName(asked.select(*asking.columns)).select(name.alias("block"), "asks", "rep", "size", "vector")
    counted = (
        dealt.repartition("block")
        .sortWithinPartitions("block")
        .mapInArrow(_block_counts(threshold, kind), "rep long, linked long")
        .groupBy("rep")
        .agg(F.sum("linked").alias("linked"))
    )
    # the hashes of a class come back with the vector that gave it its id
    keys = rows.where("vector IS NOT NULL").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size"))
    known = keys.join(groups.join(counted, "rep"), "rep", "left")
    valid = (
        rows.where("vector IS NOT NULL")
        .select("vec_id", "h1", "h2")
        .join(known, ["h1", "h2"])
        .select(
            "vec_id",
            (F.coalesce("linked", "size") - 1).cast("long").alias("n_links"),
            F.coalesce("component", "rep").cast("long").alias("component_id"),
        )
    )
    alone = rows.where("vector IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return valid.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
