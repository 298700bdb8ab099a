"""Near-duplicate documents by a chosen-path similarity join over minwise signatures.

1. Every text becomes the set of its word shingles (64-bit hashes) and a signature of minwise values: PATH_PLACES of them, on which trees
   branch, and two bits of each of CODE_PLACES, by which rows are compared. Texts with the same set (a 128-bit hash) are one class
   from here on.
2. Independent trees branch the classes: at each node one or two of the places are chosen by a hash of the path, and a class goes to the
   child named by its value there. A pair at the threshold survives each level in 1.0 children on average, so levels cost little recall.
   Their number follows from the number of classes (nodes stay small), the number of trees from the levels and the target recall
   (``plan_trees``). Nodes that are still large branch on, and the trees are planned for that depth.
3. Every node is compared exhaustively; one with very many rows in blocks, each with each, in several tasks. Rows whose codes agree
   well enough are candidates.
4. Candidates are confirmed on full sets before anything is connected. First a star cover: each row with the first row of its node that
   it may be linked with; that settles groups of copies with a comparison for each copy. Then, between rows that the confirmed links
   haven't connected, the candidates that agree best for each group, a few in each node. Unrelated texts that share a template become no
   group, as their candidates fail.
5. Groups with more candidates than that form families, whose rows are compared in blocks, codes first and full sets where codes
   agree, without a row per pair.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_up_to, materialize, without_rows
from .components import connected_components, star_edges
from .text_arrays import Words, chunks, mix, stream

PATH_PLACES, CODE_PLACES = 128, 256
#: Levels bring nodes of unrelated rows down to about so many.
SMALL_NODE = 64
#: Node sizes up to which all pairs are looked at by position, many nodes at once.
GAPS = 32
_FACTOR = stream(21, CODE_PLACES) | np.uint64(1)
_FLIP = stream(22, CODE_PLACES)
_ODD_BITS = np.uint64(0x5555555555555555)
#: Words of a code, and how many of them are looked at first.
_CODE_WORDS, _FIRST_WORDS = CODE_PLACES // 32, 2
#: Ids, of 16 bytes, that are broadcast; for more, the join shuffles.
MOST_BROADCAST = 250_000


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted, one after the other, and how many each text has."""
    table = Words(texts, lower=True)
    per_text = np.bincount(table.text, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(per_text)[:-1]])
    counts = np.where(per_text == 0, 0, np.maximum(per_text - words + 1, 1))
    owner = np.repeat(np.arange(len(texts)), counts)
    if len(owner) == 0:
        return np.zeros(0, dtype=np.uint64), counts
    begin = np.concatenate([[0], np.cumsum(counts)[:-1]])
    start = first[owner] + np.arange(len(owner)) - begin[owner]
    short = per_text[owner]
    value = np.full(len(owner), 0x5851F42D4C957F2D, dtype=np.uint64)
    for k in range(words):
        inside = k < short
        step = mix(value * np.uint64(0x9E3779B97F4A7C15) + table.hash[np.minimum(start + k, len(table.hash) - 1)])
        value = np.where(inside, step, value)
    for a, n in zip(begin, counts):
        value[a : a + n].sort()
    fresh = np.concatenate([[True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])])
    return value[fresh], np.bincount(owner[fresh], minlength=len(texts))


def signatures(sets: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts with shingles: 16 bits of each value for paths, the codes, and two 64-bit hashes of the set."""
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    paths = np.empty((len(counts), PATH_PLACES), dtype=np.uint16)
    codes = np.zeros((len(counts), _CODE_WORDS), dtype=np.uint64)
    work = np.empty_like(sets)
    for k in range(CODE_PLACES):
        np.bitwise_xor(sets, _FLIP[k], out=work)
        np.multiply(work, _FACTOR[k], out=work)
        value = mix(np.minimum.reduceat(work, first))
        if k < PATH_PLACES:
            paths[:, k] = value & np.uint64(0xFFFF)
        codes[:, k // 32] |= (value >> np.uint64(62)) << np.uint64(2 * (k % 32))
    h1 = np.add.reduceat(mix(sets ^ np.uint64(0x1234567890ABCDEF)), first)
    h2 = np.add.reduceat(mix(sets ^ np.uint64(0x0FEDCBA987654321)), first)
    return paths, codes, h1.view(np.int64), h2.view(np.int64)


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as a binary column."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width)
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def _matrix(column: pa.Array, kind, width: int) -> np.ndarray:
    """A binary column of rows of one width as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, width)


_SKETCH = "doc_id long, mark long, n_shingles long, h1 long, h2 long, paths binary, code binary"


def _sketched(words: int) -> Callable:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, run in chunks(batch.column(2).to_pylist(), 1 << 18):
                sets, counts = shingle_sets(run, words)
                full = np.flatnonzero(counts)
                h1, h2 = np.zeros(len(run), np.int64), np.zeros(len(run), np.int64)
                paths, codes = np.zeros((len(run), PATH_PLACES), np.uint16), np.zeros((len(run), _CODE_WORDS), np.uint64)
                if len(full):
                    paths[full], codes[full], h1[full], h2[full] = signatures(sets, counts[full])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(first, len(run)) for k in (0, 1)), pa.array(counts.astype(np.int64)), pa.array(h1), pa.array(h2), _binary(paths), _binary(codes)],
                    names=["doc_id", "mark", "n_shingles", "h1", "h2", "paths", "code"],
                )

    return sketch


# Trees ---------------------------------------------------------------------------------------------------------


def survival(levels: int, threshold: float, alike: float | None = None) -> float:
    """The chance that a pair whose values agree in a share ``alike`` of the places shares a node after so many levels of one tree."""
    alike = threshold if alike is None else alike
    extra, q = 1 / threshold - 1, 1.0
    for _ in range(levels):
        kept = alike * q
        q = (1 - extra) * kept + extra * (1 - (1 - kept) ** 2)
    return q


def pair_recall(trees: int, levels: int, threshold: float) -> float:
    """The chance that a pair at the threshold shares a node of some tree: the trees share the places, whose agreement is binomial."""
    shares = [math.comb(PATH_PLACES, k) * threshold**k * (1 - threshold) ** (PATH_PLACES - k) for k in range(PATH_PLACES + 1)]
    return 1 - sum(p * (1 - survival(levels, threshold, k / PATH_PLACES)) ** trees for k, p in enumerate(shares))


def plan_levels(n: int, background: float = 0.05) -> int:
    """Levels that bring nodes of unrelated texts, which share ``background`` of their shingles, down to small ones."""
    return max(2, math.ceil(math.log(max(n, 1) / SMALL_NODE + 1) / math.log(1 / background)))


def plan_trees(levels: int, threshold: float, recall: float) -> int:
    """The number of trees by which a pair at the threshold meets in a node with the probability ``recall``."""
    return next(k for k in range(1, 10_000) if pair_recall(k, levels, threshold) >= recall)


def _choice(path: np.ndarray, level: int, extra: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The place that a node branches on, whether it has a second one, and that one."""
    r = mix(path + np.uint64(0x2545F4914F6CDD1D * (level + 1) & 0xFFFFFFFFFFFFFFFF))
    one = (r & np.uint64(0xFFFF)) % np.uint64(PATH_PLACES)
    other = (one + np.uint64(1) + ((r >> np.uint64(16)) & np.uint64(0xFFFF)) % np.uint64(PATH_PLACES - 1)) % np.uint64(PATH_PLACES)
    second = (r >> np.uint64(32)).astype(np.float64) < extra * 2**32
    return one.astype(np.int64), second, other.astype(np.int64)


def _branched(trees: int | None, first_level: int, levels: int, threshold: float) -> Callable:
    """Rows (node, rep, n_shingles, code, paths) come back in their nodes ``levels`` further down; with ``trees``, from the roots of so many."""
    extra = 1 / threshold - 1

    def branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                values = _matrix(part.column(4), np.uint16, PATH_PLACES)
                roots = [part.column(0).to_numpy(zero_copy_only=False).view(np.uint64)]
                if trees is not None:
                    roots = [np.full(len(values), mix(np.array([tree + 1], dtype=np.uint64))[0]) for tree in range(trees)]
                for path in roots:
                    row = np.arange(len(values))
                    for level in range(first_level, first_level + levels):
                        one, second, other = _choice(path, level, extra)
                        row = np.concatenate([row, row[second]])
                        place = np.concatenate([one, other[second]])
                        path = np.concatenate([path, path[second]])
                        path = mix(path ^ mix(values[row, place].astype(np.uint64) << np.uint64(8) | place.astype(np.uint64)))
                    taken = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(path.view(np.int64)), *(part.column(k).take(taken) for k in (1, 2, 3))], names=["node", "rep", "n_shingles", "code"]
                    )

    return branch


_GROWN = "node long, rep long, n_shingles int, code binary"


def grown_nodes(classes: DataFrame, trees: int, levels: int, threshold: float, branch_rows: int, deepest: int) -> DataFrame:
    """(node, rep, n_shingles, code) of all trees; nodes of over ``branch_rows`` rows branch on, two levels at a time, ``deepest`` times at most."""
    own = classes.select(F.lit(0).cast("long").alias("node"), "rep", "n_shingles", "code", "paths")
    nodes, done = own.mapInArrow(_branched(trees, 0, levels, threshold), _GROWN), None
    for step in range(deepest + 1):
        sizes = nodes.select("node").groupBy("node").agg(F.count(F.lit(1)).alias("n"))
        large = materialize(sizes.where(F.col("n") > branch_rows).select("node"))
        if step == deepest or large.isEmpty():
            break
        large = broadcast_up_to(large, MOST_BROADCAST)
        kept = nodes.join(large, "node", "left_anti")
        done = kept if done is None else done.unionByName(kept)
        inside = nodes.join(large, "node", "left_semi").join(classes.select("rep", "paths"), "rep").select("node", "rep", "n_shingles", "code", "paths")
        nodes = inside.mapInArrow(_branched(None, levels + 2 * step, 2, threshold), _GROWN)
    return nodes if done is None else done.unionByName(nodes)


def has_large_nodes(classes: DataFrame, levels: int, threshold: float, branch_rows: int) -> bool:
    """Whether the first tree has a node of over ``branch_rows`` rows."""
    if classes.count() <= branch_rows:
        return False
    own = classes.select(F.lit(0).cast("long").alias("node"), "rep", "n_shingles", "code", "paths")
    nodes = own.mapInArrow(_branched(1, 0, levels, threshold), _GROWN).select("node")
    return not nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > branch_rows).isEmpty()


def dealt_nodes(nodes: DataFrame, block_rows: int) -> DataFrame:
    """Rows (node, left, rep, label, n_shingles, code), sorted by node. A node of over ``block_rows`` rows is cut into blocks, each two of which are a
    node of their own; ``left`` tells them apart and is true throughout where there is one block."""
    sizes = nodes.select("node").groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_rows)
    cut = materialize(sizes.select("node", F.ceil(F.col("n") / block_rows).cast("int").alias("cut")))
    ready = nodes.withColumn("left", F.lit(True))
    if not cut.isEmpty():
        placed = nodes.join(broadcast_up_to(cut, MOST_BROADCAST), "node", "left")
        placed = placed.withColumn("cut", F.coalesce("cut", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("cut")).cast("int"))
        placed = placed.withColumn("other", F.explode(F.expr("sequence(0, cut - 1)")))
        own = F.xxhash64("node", F.least("part", "other"), F.greatest("part", "other"))
        ready = placed.withColumn("node", F.when(F.col("cut") > 1, own).otherwise(F.col("node"))).withColumn("left", F.col("part") <= F.col("other"))
    columns = ["node", "left", "rep", *(["label"] if "label" in nodes.columns else []), "n_shingles", "code"]
    return ready.select(*columns).repartition("node").sortWithinPartitions("node", "rep")


# Candidates ----------------------------------------------------------------------------------------------------


def _disagreements(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many places codes differ."""
    z = x ^ y
    return np.bitwise_count((z | (z >> np.uint64(1))) & _ODD_BITS).sum(axis=-1, dtype=np.int64)


class Node:
    """Rows of some nodes. ``least``: the places in which the codes of candidates agree; ``percent``: their sizes can meet it."""

    def __init__(self, left: np.ndarray, rep: np.ndarray, label: np.ndarray, n: np.ndarray, code: np.ndarray, least: int, percent: int):
        self.left, self.rep, self.label, self.n, self.code, self.percent = left, rep, label, n, code, percent
        self.most = CODE_PLACES - least
        share = self.most / CODE_PLACES  # of the first words, a candidate may miss some more by chance
        first = 32 * _FIRST_WORDS
        self.most_first = math.ceil(first * share + 5 * math.sqrt(first * share * (1 - share)))

    def fit(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs are candidates (by position)."""
        n, m = self.n[i], self.n[j]
        at = np.flatnonzero((100 * np.minimum(n, m) >= self.percent * np.maximum(n, m)) & (self.label[i] != self.label[j]))
        at = at[_disagreements(self.code[i[at], :_FIRST_WORDS], self.code[j[at], :_FIRST_WORDS]) <= self.most_first]
        return at[_disagreements(self.code[i[at]], self.code[j[at]]) <= self.most]

    def partners(self, i: int, others: np.ndarray) -> np.ndarray:
        """The positions in ``others`` that are candidates with row ``i``."""
        return self.fit(np.full(len(others), i), others)


def _gap_pairs(rows: Node, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All candidates inside nodes of at most GAPS rows, which are runs."""
    left, right = [], []
    for gap in range(1, GAPS):
        at = np.flatnonzero(node[gap:] == node[:-gap])
        if len(at) == 0:
            break
        for k in range(0, len(at), 1 << 15):
            i = at[k : k + (1 << 15)]
            hit = i[rows.fit(i, i + gap)]
            left.append(hit)
            right.append(hit + gap)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = np.concatenate(left), np.concatenate(right)
    order = np.lexsort((j, i))
    return i[order], j[order]


def _stars(rows: Node, asks: np.ndarray, others: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each of the ``others`` with the first of ``asks`` that it is a candidate with. Where both are the same rows, who has found one asks no more."""
    waiting, same = others, asks is others
    for pivot in asks:
        if len(waiting) == 0:
            return
        if same:
            if waiting[0] != pivot:
                continue
            waiting = waiting[1:]
        found = rows.partners(int(pivot), waiting)
        if len(found):
            yield np.full(len(found), pivot), waiting[found]
            waiting = np.delete(waiting, found)


def star_edges_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Few edges with the same components as the edges between the ids ``a`` and ``b``."""
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    return star_edges(ids, place[: len(a)], place[len(a) :])


def _star_of_pairs(i: np.ndarray, j: np.ndarray) -> tuple[list[int], list[int]]:
    """The same from pairs in order: pairs whose first row hasn't been taken take their second one."""
    taken, left, right = set(), [], []
    for a, b in zip(i.tolist(), j.tolist()):
        if a not in taken and b not in taken:
            taken.add(b)
            left.append(a)
            right.append(b)
    return left, right


def _best(rows: Node, i: np.ndarray, j: np.ndarray, node: np.ndarray, tries: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``tries`` pairs of each label in each node that agree best, and the labels that have others."""
    apart = _disagreements(rows.code[i], rows.code[j])
    pair = np.tile(np.arange(len(i)), 2)
    label = np.concatenate([rows.label[i], rows.label[j]])
    other = np.concatenate([rows.rep[j], rows.rep[i]])
    order = np.lexsort((other, apart[pair], label, node[i][pair]))
    where, who = node[i][pair][order], label[order]
    start = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]) | (who[1:] != who[:-1])])) if len(i) else np.zeros(0, np.int64)
    place = np.arange(len(order)) - np.repeat(start, np.diff(np.concatenate([start, [len(order)]])))
    keep = np.zeros(len(i), dtype=bool)
    keep[pair[order][place < tries]] = True
    return i[keep], j[keep], np.unique(np.concatenate([rows.label[i[~keep]], rows.label[j[~keep]]]))


STARS, BEST, FAMILIES = "stars", "best", "families"


def _candidates(least: int, percent: int, wanted: str, tries: int = 0) -> Callable:
    """Rows (node, left, rep, label, n_shingles, code), sorted by node and rep, become pairs (a, b, more).

    STARS: a star cover of each node. BEST: of the candidates with different labels, the ``tries`` best of each label, and a row with ``more`` and twice
    the label for each one that has others. FAMILIES: edges between labels, which connect those that have candidates.
    """

    def batch_of(a: np.ndarray, b: np.ndarray, more: bool = False) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.full(len(a), more))], names=["a", "b", "more"])

    def search(node: np.ndarray, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = Node(*columns, least, percent)

        def out(i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
            if wanted == FAMILIES:
                yield batch_of(*star_edges_of(rows.label[i], rows.label[j]))
                return
            if wanted == BEST:
                i, j, more = _best(rows, i, j, node, tries)
                yield batch_of(more, more, True)
            yield batch_of(rows.rep[i], rows.rep[j])

        start = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        size = np.diff(np.concatenate([start, [len(node)]]))
        one = ~np.logical_or.reduceat(~columns[0], start)  # not two blocks of a node
        small = one & (size > 1) & (size <= GAPS)
        at = np.flatnonzero(np.repeat(small, size))
        i, j = _gap_pairs(Node(*(c[at] for c in columns), least, percent), node[at])
        i, j = at[i], at[j]
        if wanted == STARS:
            left, right = _star_of_pairs(i, j)
            i, j = np.array(left, np.int64), np.array(right, np.int64)
        yield from out(i, j)
        large = ~small & (size > 1)
        for first, n, whole in zip(start[large], size[large], one[large]):
            everyone = np.arange(first, first + n)
            asks, others = (everyone, everyone) if whole else (everyone[rows.left[everyone]], everyone[~rows.left[everyone]])
            if wanted == STARS:
                for i, j in _stars(rows, asks, others):
                    yield from out(i, j)
                continue
            found_i, found_j, held = [everyone[:0]], [everyone[:0]], 0
            for k, pivot in enumerate(asks):
                others_now = others[k + 1 :] if whole else others
                hit = others_now[rows.partners(int(pivot), others_now)]
                found_i.append(np.full(len(hit), pivot))
                found_j.append(hit)
                held += len(hit)
                if held > 1 << 18:  # what is found so far goes on; each part keeps its own best
                    yield from out(np.concatenate(found_i), np.concatenate(found_j))
                    found_i, found_j, held = [everyone[:0]], [everyone[:0]], 0
            yield from out(np.concatenate(found_i), np.concatenate(found_j))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, columns = np.zeros(0, np.int64), None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            names = batch.schema.names
            number = {c: batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in names if c != "code"}
            number["left"] = number["left"].astype(bool)
            code = _matrix(batch.column(names.index("code")), np.uint64, _CODE_WORDS)
            new = [number["left"], number["rep"], number.get("label", number["rep"]), number["n_shingles"].astype(np.int64), code]
            node = np.concatenate([node, number["node"]])
            columns = new if columns is None else [np.concatenate(x) for x in zip(columns, new)]
            other = np.flatnonzero(node != node[-1])
            cut = int(other[-1]) + 1 if len(other) else 0  # the last node may go on in the next batch
            if cut:
                yield from search(node[:cut], [c[:cut] for c in columns])
                node, columns = node[cut:], [c[cut:] for c in columns]
        if len(node):
            yield from search(node, columns)

    return run


# Confirmation --------------------------------------------------------------------------------------------------


def linked(percent: int, common: int, n: int, m: int) -> bool:
    """Whether intersection and union meet the threshold, in whole numbers."""
    return 100 * common >= percent * (n + m - common)


def _sets(words: int) -> Callable:
    """Rows (rep, text) become (rep, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in chunks(batch.column(1).to_pylist()):
                sets, counts = shingle_sets(texts, words)
                ends = np.cumsum(counts)
                rows = [sets[e - n : e].tobytes() for e, n in zip(ends, counts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(rows, pa.binary())], names=["rep", "shingles"])

    return run


def _confirmed(percent: int) -> Callable:
    """Rows (block, pivot, rep, shingles), sorted with the pivot of each block first, become the links of the others with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep, mine = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for pivot, other, shingles in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                own = np.frombuffer(shingles.as_buffer(), np.uint64)
                if pivot:
                    rep, mine = other, own.copy()
                    continue
                if linked(percent, _shared(own, mine), len(own), len(mine)):
                    a.append(rep)
                    b.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def confirmed_links(pairs: DataFrame, sets: DataFrame, percent: int, share: int = 256) -> DataFrame:
    """The pairs (a, b) that are linked on full sets (rep, shingles). ``share``: partners of a row that one task takes; a row with more of them is
    dealt over several."""
    crowd = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > share)
    crowd = materialize(crowd.select("a", F.ceil(F.col("k") / share).cast("int").alias("parts")))
    cut = pairs.join(broadcast_up_to(crowd, MOST_BROADCAST), "a", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    cut = cut.select("a", "b", "parts", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    members = cut.select(F.xxhash64("a", "part").alias("block"), F.col("b").alias("rep"), F.lit(False).alias("pivot"), F.col("a").alias("of"))
    pivots = cut.select(F.xxhash64("a", "part").alias("block"), F.col("a").alias("rep"), F.lit(True).alias("pivot"), F.col("a").alias("of")).distinct()
    rows = members.unionByName(pivots).join(sets, "rep").select("block", "pivot", "rep", "shingles", "of")
    dealt = rows.repartition("block", "of").sortWithinPartitions("block", "of", F.desc("pivot"))
    return dealt.select("block", "pivot", "rep", "shingles").mapInArrow(_confirmed(percent), "a long, b long")


def _shared(one: np.ndarray, two: np.ndarray) -> int:
    """The size of the intersection of two sorted sets."""
    few, many = (one, two) if len(one) < len(two) else (two, one)
    place = np.minimum(np.searchsorted(many, few), len(many) - 1)
    return int((many[place] == few).sum())


def _family_links(least: int, percent: int) -> Callable:
    """Rows (block, left, rep, label, n_shingles, code, shingles), sorted by block, become links between the labels of each block."""

    def close(rows: list[tuple]) -> pa.RecordBatch:
        left, rep, label, n, code, sets = zip(*rows)
        node = Node(
            np.array(left), np.array(rep, np.int64), np.array(label, np.int64), np.array(n, np.int64), np.frombuffer(b"".join(code), np.uint64).reshape(-1, _CODE_WORDS), least, percent
        )
        asks = np.flatnonzero(node.left)
        others = asks if node.left.all() else np.flatnonzero(~node.left)
        a, b = [], []
        for pivot in asks.tolist():
            mine = np.frombuffer(sets[pivot], np.uint64)
            for other in others[node.partners(pivot, others)].tolist():
                if node.label[pivot] == node.label[other]:
                    continue  # connected meanwhile
                own = np.frombuffer(sets[other], np.uint64)
                if linked(percent, _shared(own, mine), len(own), len(mine)):
                    a.append(rep[pivot])
                    b.append(rep[other])
                    node.label[node.label == node.label[other]] = node.label[pivot]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, rows = None, []
        for batch in batches:
            for block, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if block != name and rows:
                    yield close(rows)
                    rows = []
                name = block
                rows.append(tuple(row))
        if rows:
            yield close(rows)

    return run


def family_links(members: DataFrame, least: int, percent: int, rows_at_once: int = 1024, weight: int = 2_000_000) -> DataFrame:
    """Links between rows of different labels inside each family: members (family, rep, label, n_shingles, code, shingles). A block has about
    ``rows_at_once`` rows and ``weight`` shingles at most; every two blocks of a family meet in one task."""
    size = F.greatest(F.count(F.lit(1)) / rows_at_once, F.sum("n_shingles") / weight)
    cuts = members.groupBy("family").agg(F.greatest(F.ceil(size), F.lit(1)).cast("int").alias("cut"))
    placed = members.join(cuts, "family").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("cut")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.expr("sequence(0, cut - 1)")))
    block = F.to_json(F.struct("family", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high")))
    dealt = placed.select(block.alias("block"), (F.col("part") <= F.col("other")).alias("left"), "rep", "label", "n_shingles", "code", "shingles")
    return dealt.repartition("block").sortWithinPartitions("block").mapInArrow(_family_links(least, percent), "a long, b long")


# The join ------------------------------------------------------------------------------------------------------


def _components(
    documents: DataFrame, words: int, percent: int, recall: float, block_rows: int, branch_rows: int, tries: int
) -> DataFrame:
    """One row per document: doc_id, mark (a hash of the text), n_shingles, h1, h2, group (null for rows that link with nothing) and component_id."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    sketches = materialize(rows.mapInArrow(_sketched(words), _SKETCH))
    keys = ["h1", "h2"]
    found = sketches.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = found.groupBy(*keys).agg(
        F.min("doc_id").alias("least"), F.first("n_shingles").cast("int").alias("n_shingles"), F.first("code").alias("code"), F.first("paths").alias("paths")
    )
    classes = materialize(classes)
    twice = materialize(classes.groupBy("least").agg(F.count(F.lit(1)).alias("k")).where("k > 1"))
    if twice.isEmpty():
        classes = classes.withColumn("rep", F.col("least"))
    else:  # ids that come with different texts: their classes are told apart by the sets' hashes
        named = classes.join(broadcast_up_to(twice, MOST_BROADCAST), "least", "left")
        classes = materialize(named.withColumn("rep", F.when(F.col("k").isNull(), F.col("least")).otherwise(F.xxhash64("least", *keys))).drop("k"))

    threshold, n = percent / 100, classes.count()
    levels = plan_levels(n)
    deepest = 3 if has_large_nodes(classes, levels, threshold, branch_rows) else 0
    trees = plan_trees(levels + 2 * deepest, threshold, recall)
    alike = threshold + (1 - threshold) / 4  # two bits agree by chance in a quarter
    least = math.ceil(CODE_PLACES * (alike - 4.2 * math.sqrt(alike * (1 - alike) / CODE_PLACES)))

    def candidates(some: DataFrame, labels: DataFrame | None, wanted: str) -> DataFrame:
        nodes = grown_nodes(some, trees, levels, threshold, branch_rows, deepest)
        if labels is not None:
            nodes = nodes.join(labels, "rep")
        pairs = dealt_nodes(nodes, block_rows).mapInArrow(_candidates(least, percent, wanted, tries), "a long, b long, more boolean")
        return materialize(pairs.distinct())

    def labelled(links: DataFrame) -> DataFrame:
        joined = connected_components(links).select(F.col("id").alias("rep"), F.col("component").alias("label"))
        return materialize(involved.join(joined, "rep", "left").select("rep", F.coalesce("label", "rep").alias("label")))

    pairs = candidates(classes, None, STARS).drop("more")
    involved = materialize(pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct())
    some = materialize(classes.join(broadcast_up_to(involved, MOST_BROADCAST), "rep", "left_semi"))
    wanted = broadcast_up_to(some.select(F.col("least").alias("doc_id"), *keys, "rep"), MOST_BROADCAST)
    chosen = materialize(sketches.select("doc_id", "mark", *keys).join(wanted, ["doc_id", *keys]).select("doc_id", "mark", "rep"))
    texts = rows.join(broadcast_up_to(chosen.distinct(), MOST_BROADCAST), ["doc_id", "mark"]).select("rep", "text")
    sets = materialize(texts.mapInArrow(_sets(words), "rep long, shingles binary"))
    if chosen.count() > some.count():  # rows repeat ids
        sets = materialize(sets.dropDuplicates(["rep"]))

    links = materialize(confirmed_links(pairs, sets, percent))
    before = labelled(links)
    pairs = candidates(some, before, BEST)
    links = materialize(links.unionByName(confirmed_links(pairs.where("NOT more").drop("more"), sets, percent)))
    crowded = materialize(before.join(pairs.where("more").select(F.col("a").alias("label")), "label", "left_semi").select("rep"))
    if not crowded.isEmpty():
        labels = labelled(links).join(crowded, "rep")
        rest = some.join(crowded, "rep", "left_semi")
        families = connected_components(candidates(rest, labels, FAMILIES)).select(F.col("id").alias("label"), F.col("component").alias("family"))
        members = rest.select("rep", "n_shingles", "code").join(labels, "rep").join(families, "label").join(sets, "rep")
        links = materialize(links.unionByName(family_links(members, least, percent)))
    joined = materialize(connected_components(links).select(F.col("id").alias("rep"), F.col("component").alias("group")))
    joined = broadcast_up_to(joined, MOST_BROADCAST)
    own = classes.select(*keys, "rep", "least")
    groups = materialize(own.join(joined, "rep").groupBy("group").agg(F.min("least").alias("component_id")))
    members = own.join(joined, "rep", "left").join(broadcast_up_to(groups, MOST_BROADCAST), "group", "left")
    members = members.select(*keys, F.coalesce("group", "rep").alias("group"), F.coalesce("component_id", "least").alias("component_id"))
    placed = sketches.select("doc_id", "mark", "n_shingles", *keys).join(members, keys, "left")
    linked_rows = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    return placed.select(
        "doc_id", "mark", "n_shingles", *keys, F.when(linked_rows, F.col("group")).alias("group"), F.when(linked_rows, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def near_duplicates(
    documents: DataFrame,
    words: int = 5,
    percent: int = 80,
    recall: float = 0.9999,
    block_rows: int = 4096,
    branch_rows: int = 1 << 16,
    tries: int = 4,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Two documents are linked when 100 * intersection >= ``percent`` * union of their sets of ``words``-word shingles (A-Z lower-cased;
    words are runs without ASCII white space; with fewer words, the whole sequence is the one shingle). ``component_id`` is the
    least doc_id that links reach, itself included; ``kept`` says whether that is the document. All links are confirmed on full sets. A pair
    at the threshold is compared with the probability ``recall`` or more, at any number of rows: nodes of trees are compared exhaustively
    (over ``block_rows`` rows, in blocks), and where nodes of over ``branch_rows`` rows branch on, there are more trees for it. ``tries``: candidates of a
    group that are confirmed in each node before the others are compared in blocks.

    Texts that are null, empty or have no words have no shingles and are linked with nothing. Rows with a null doc_id are linked with
    nothing either, have a null component and are kept. Rows that repeat an id each come back, with the component of their own text. An
    empty table gives an empty result; other columns are ignored.
    """
    found = _components(documents, words, percent, recall, block_rows, branch_rows, tries).select("doc_id", "n_shingles", "component_id")
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(documents: DataFrame, words: int = 5, percent: int = 80, recall: float = 0.9999) -> DataFrame:
    """The rows of ``documents`` that stay: one document of each component, with all its columns. See ``near_duplicates``.

    Decided by doc_id and text: where an id repeats with different texts, a dropped copy takes no other text with it; of rows
    that repeat id and text one stays.
    """
    rows = materialize(_components(documents, words, percent, recall, 4096, 1 << 16, 4).where("doc_id IS NOT NULL").select("doc_id", "mark", "group", "component_id"))
    kept = rows.where("doc_id = component_id")
    again = kept.where("group IS NOT NULL").groupBy("group").agg(F.min("mark").alias("first"), F.max("mark").alias("last")).where("first < last")
    beside = kept.join(again, "group").where("mark > first")  # texts of one id that are near copies of each other
    dropped = rows.where("doc_id <> component_id").select("doc_id", "mark").unionByName(beside.select("doc_id", "mark")).distinct()
    repeated = rows.groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("doc_id", "mark")
    return without_rows(documents, F.xxhash64(F.coalesce("text", F.lit(""))), "mark", dropped, repeated, MOST_BROADCAST)
