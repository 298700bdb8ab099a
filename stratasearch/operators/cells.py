"""BM25 top-k for batches, from cells of chunks with bounds: only chunks that can reach the k best are scored.

``pruned.PrunedIndex`` deals postings by token, so what queries ask for meets again by chunk, with a row for each pair of query and posting: right for few
queries with rare words, too much for a batch with common ones. A cell holds all postings of up to CELL chunks of like length, made where the chunks are, with
each token's greatest count and least length; nothing is shuffled. A search has two passes over cells. Of each query the cells with the greatest bounds are scored
first; the k-th best score there is a threshold that the k-th best of all reaches. Then each task leaves out the cells whose bound stays below, and in the others the
chunks that hold only tokens which stay below together. All results are exact, equal scores included.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.plain import text_blocks, token_lists
from ..sources.tables import kept
from .bm25 import K1, MOST_CELLS, SCORE_PLACES, B, asked_matrix, query_tokens, top
from .pruned import MARGIN

#: Chunks and tokens of a cell, tokens that a task holds to sort their chunks by length, and cells of each query that the first pass scores.
CELL, CELL_TOKENS, HELD_TOKENS, FIRST = 1024, 1 << 20, 4 << 20, 2
#: Cells of a stored file. Spark's reader decodes a row group's lists at once, several times as large as they are stored, and the writer closes none before 100 rows.
FILE_CELLS = 8
#: Words of a batch up to which an index can be made for it alone.
MOST_WORDS = 200_000


def cells(tokens: DataFrame, size: int = CELL, words: list[str] | None = None) -> DataFrame:
    """Cells of chunks (chunk_id, repo_id, tokens), to be stored before they are searched. ``bm25.texts_of`` may stand for tokens: texts are cut in the tasks then, a block at a time.

    All chunks and their whole lengths are there, and the postings of all tokens, or of ``words`` alone.
    ``chunk_ids``, ``repo_ids``, ``lengths`` are by chunk, ``tokens``, ``ends`` (of their postings), ``most`` (count) and ``least`` (length) by token, ``places`` (of chunks) and ``tfs`` by posting.
    """
    cut = "text" in tokens.columns
    ids = [T.ArrayType(tokens.schema[name].dataType) for name in ("chunk_id", "repo_id")]
    numbers = T.ArrayType(T.IntegerType())
    schema = T.StructType().add("cell", T.LongType()).add("n", T.LongType()).add("total", T.LongType()).add("chunk_ids", ids[0]).add("repo_ids", ids[1]).add("lengths", numbers)
    schema = schema.add("tokens", T.ArrayType(T.StringType())).add("ends", numbers).add("most", numbers).add("least", numbers).add("places", T.ArrayType(T.ShortType())).add("tfs", numbers)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, lists in enumerate(_cells_of(batches, size, cut, words), TaskContext.get().partitionId() << 32):
            single = [pa.array([x], pa.int64()) for x in (number, len(lists[0]), pc.sum(lists[2]).as_py())]
            yield pa.RecordBatch.from_arrays([*single, *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists)], names=names)

    return tokens.select("chunk_id", "repo_id", "text" if cut else "tokens").mapInArrow(run, schema)


def _cells_of(batches: Iterator[pa.RecordBatch], size: int, cut: bool, words: list[str] | None = None) -> Iterator[list[pa.Array]]:
    """The lists of each cell of a task, from ids and texts (``cut``) or ids and lists of tokens.

    Of what it has read a task holds ids, lengths and places of tokens in dictionaries, for HELD_TOKENS tokens and one more block of texts.
    """
    held, count = [], 0
    for batch in batches:
        for part in text_blocks(batch, 2) if cut else [batch]:
            lists = token_lists(part.column(2)) if cut else part.column(2)
            length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            flat = lists.flatten() if cut else lists.flatten().dictionary_encode()
            code, dictionary, n = flat.indices.to_numpy(zero_copy_only=False).astype(np.int32), flat.dictionary, length
            if words is not None:
                good = pc.is_in(dictionary, value_set=pa.array(words, dictionary.type)).to_numpy(zero_copy_only=False)
                n = np.diff(np.append(0, np.cumsum(good[code]))[np.append(0, np.cumsum(length))])
                code, dictionary = (np.cumsum(good) - 1)[code[good[code]]].astype(np.int32), dictionary.filter(pa.array(good))
            rows = pa.array(np.arange(len(part)))  # taken, so that no text stays for its row's ids
            held.append((*(part.column(i).take(rows) for i in (0, 1)), length, n, code, dictionary))
            count += len(code) + len(part)
            if count >= HELD_TOKENS:
                yield from _sorted_cells(held, size)
                held, count = [], 0
    if held:
        yield from _sorted_cells(held, size)


def _sorted_cells(held: list[tuple], size: int) -> Iterator[list[pa.Array]]:
    """The lists of the cells that held blocks give, their chunks sorted by length."""
    words = pa.concat_arrays([x[5] for x in held]).dictionary_encode()  # the blocks' dictionaries, which may name a word twice
    place, before = words.indices.to_numpy(zero_copy_only=False), np.cumsum([0, *(len(x[5]) for x in held)])
    codes, words = np.concatenate([place[x[4] + n] for x, n in zip(held, before)]), words.dictionary
    chunks, repos = (pa.concat_arrays([x[i] for x in held]) for i in (0, 1))
    length, sizes = (np.concatenate([x[i] for x in held]).astype(np.int64) for i in (2, 3))  # all tokens of a chunk, and those that are kept
    begin, order, at = np.cumsum(sizes) - sizes, np.argsort(length, kind="stable"), 0
    while at < len(order):
        rows = order[at : at + size]
        rows = rows[: max(1, np.searchsorted(np.cumsum(sizes[rows]), CELL_TOKENS, "right"))]
        size_of, n = sizes[rows], len(rows)
        behind = np.cumsum(size_of) - size_of
        code = codes[np.repeat(begin[rows] - behind, size_of) + np.arange(size_of.sum())].astype(np.int64)
        place, tf = np.unique(code * n + np.repeat(np.arange(n), size_of), return_counts=True)
        code, place = np.divmod(place, n)
        starts = np.flatnonzero(np.diff(code, prepend=-1))
        most, least = (f.reduceat(x, starts) if len(starts) else x for f, x in ((np.maximum, tf), (np.minimum, length[rows][place])))
        by_token = [words.take(pa.array(code[starts])), *(pa.array(x, pa.int32()) for x in (np.append(starts[1:], len(tf))[: len(starts)], most, least))]
        yield [chunks.take(pa.array(rows)), repos.take(pa.array(rows)), pa.array(length[rows], pa.int32()), *by_token, pa.array(place, pa.int16()), pa.array(tf, pa.int32())]
        at += n


@dataclass(frozen=True)
class _Asked:
    """A part of a batch that goes to every task."""

    words: list[str]
    ids: list
    counts: np.ndarray
    idf: np.ndarray
    avgdl: float

    def weight(self, code: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        share = length / self.avgdl if self.avgdl > 0 else np.zeros(len(length))
        return self.idf[code] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * share))

    def held(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places of asked tokens among a cell's tokens, and their places in ``words``."""
        code = pc.fill_null(pc.index_in(tokens, value_set=pa.array(self.words, tokens.type)), -1).to_numpy(zero_copy_only=False)
        return np.flatnonzero(code >= 0), code[code >= 0]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Each cell: its numbers, and its lists as Arrow arrays."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: x.values if isinstance(x := batch.column(c)[i], pa.ListScalar) else x.as_py() for c, name in enumerate(batch.schema.names)}


def _numbers(x: pa.Array) -> np.ndarray:
    return x.to_numpy(zero_copy_only=False).astype(np.int64)


def _frequencies(words: list[str]):
    """(code, df) of the asked tokens in a task's cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, df = _Asked(words, [], np.zeros(0), np.zeros(0), 0.0), np.zeros(len(words), np.int64)
        for row in _rows(batches):
            at, code = asked.held(row["tokens"])
            df[code] += np.diff(_numbers(row["ends"]), prepend=0)[at]
        code = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(code, pa.int32()), pa.array(df[code], pa.int64())], names=["code", "df"])

    return run


def _promising(asked: _Asked, first: int):
    """(q, cell, bound): the ``first`` cells of a task with the greatest bounds of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, bounds = np.zeros((0, len(asked.ids)), np.int64), np.zeros((0, len(asked.ids)))
        for row in _rows(batches):
            at, code = asked.held(row["tokens"])
            most = asked.weight(code, _numbers(row["most"])[at], _numbers(row["least"])[at])
            # by query its best cells so far and this one: columns are sorted alone, so cells' numbers are kept beside each bound
            number = np.vstack([number, np.full((1, len(asked.ids)), row["cell"])])
            bounds = np.vstack([bounds, (most @ asked.counts[code])[None, :]])
            order = np.argsort(-bounds, axis=0, kind="stable")[:first]
            number, bounds = np.take_along_axis(number, order, 0), np.take_along_axis(bounds, order, 0)
        i, q = np.nonzero(bounds > 0)
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(number[i, q], pa.int64()), pa.array(bounds[i, q], pa.float64())], names=["q", "cell", "bound"])

    return run


def _best(asked: _Asked, floors: np.ndarray, k: int, only: dict[int, list[int]] | None, schema: T.StructType, tally: bool = False):
    """The ``k`` best chunks of each query in a task's cells, as far as they reach the floors. ``only``: the queries of each cell that count.

    With ``tally`` rows (q, held, scored) instead: chunks that hold a token of the query, and those that were scored for it.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    asks = [np.flatnonzero(asked.counts[:, q]) for q in range(len(asked.ids))]
    step = max(1, MOST_CELLS // max(1, len(asked.words)))  # chunks whose weights are laid out at once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor, best, work = floors.copy(), {}, np.zeros((2, len(asked.ids)), np.int64)
        for row in _rows(batches):
            at, code = asked.held(row["tokens"])
            bound = np.zeros(len(asked.words))
            bound[code] = asked.weight(code, _numbers(row["most"])[at], _numbers(row["least"])[at])
            reach = bound @ asked.counts
            wanted = np.flatnonzero((reach > 0) & (reach >= floor - MARGIN)) if only is None else np.array(only[row["cell"]])
            if tally:
                wanted = np.arange(len(asked.ids))
            if not len(wanted):
                continue
            ends = _numbers(row["ends"])
            begin, size = np.append(0, ends)[at], np.diff(ends, prepend=0)[at]
            picked = np.repeat(begin - np.append(0, np.cumsum(size))[:-1], size) + np.arange(size.sum())
            place, tf = (_numbers(row[name].take(pa.array(picked))) for name in ("places", "tfs"))
            of = np.repeat(code, size)
            gains = asked.weight(of, tf, _numbers(row["lengths"])[place])
            for lo in range(0, row["n"], step):
                here = (place >= lo) & (place < lo + step)
                weight = np.zeros((min(step, row["n"] - lo), len(asked.words)))
                weight[place[here] - lo, of[here]] = gains[here]
                for q in wanted:
                    words = asks[q]
                    gain = bound[words] * asked.counts[words, q]
                    words, gain = words[gain > 0], gain[gain > 0]
                    rising = np.argsort(gain)
                    leads = words[rising[np.cumsum(gain[rising]) >= floor[q] - MARGIN]]
                    if tally:
                        work[0, q] += (weight[:, words] > 0).any(axis=1).sum()
                        if reach[q] <= 0 or reach[q] < floor[q] - MARGIN:
                            continue
                    chunk = np.flatnonzero((weight[:, leads] > 0).any(axis=1))
                    work[1, q] += len(chunk)
                    score = np.round(weight[np.ix_(chunk, words)] @ asked.counts[words, q], SCORE_PLACES)
                    if len(score) > k:  # all that reach the k-th best, so ties are decided by id
                        floor[q] = max(floor[q], np.partition(score, len(score) - k)[len(score) - k])
                    good = (score >= floor[q]) & (score > 0)
                    if good.any():
                        names = [row[name].take(pa.array(chunk[good] + lo)).to_pylist() for name in ("chunk_ids", "repo_ids")]
                        best[q] = sorted([*best.get(q, []), *zip((-score[good]).tolist(), *names)], key=lambda x: x[:2])[:k]
                        if len(best[q]) == k:
                            floor[q] = max(floor[q], -best[q][-1][0])
        if tally:
            yield pa.RecordBatch.from_arrays([pa.array(asked.ids, arrow[0].type), *(pa.array(x, pa.int64()) for x in work)], schema=arrow)
            return
        found = [(asked.ids[q], chunk, repo, -score) for q, rows in best.items() for score, chunk, repo in rows]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], f.type) for i, f in enumerate(arrow)], schema=arrow)

    return run


@dataclass(frozen=True)
class CellIndex:
    """Stored ``cells``; ``words``: the only ones whose postings they have."""

    cells: DataFrame
    words: frozenset[str] | None = None

    @staticmethod
    def build(tokens: DataFrame, path: str, size: int = CELL, queries: DataFrame | None = None) -> CellIndex:
        """An index of ``cells`` that is written to ``path``, a few of them in a file, so that reading takes memory by the cell and not by the file.

        With ``queries`` it has the postings of their tokens only and answers no others, unless they have more than MOST_WORDS.
        """
        words = None
        if queries is not None:
            few = [r["token"] for r in query_tokens(queries).select("token").distinct().limit(MOST_WORDS + 1).collect()]
            words = few if len(few) <= MOST_WORDS else None
        made = cells(tokens, size, words)
        made.write.option("maxRecordsPerFile", FILE_CELLS).parquet(path)
        return CellIndex(tokens.sparkSession.read.schema(made.schema).parquet(path), None if words is None else frozenset(words))

    def search(self, queries: DataFrame, k: int, most_cells: int = MOST_CELLS) -> DataFrame:
        """(query_id, chunk_id, repo_id, score, rank): the k best positive scores of each query (query_id, query), as ``bm25.top`` has them.

        Batches of more than ``most_cells`` cells of tokens by queries are searched in several parts.
        """
        return top(reduce(DataFrame.unionByName, [self._found(part, k) for part in self._parts(queries, most_cells)]), k)

    def work(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, held, scored): chunks that hold a token of the query, and those that the second pass scores."""
        tasks = reduce(DataFrame.unionByName, [self._found(part, k, tally=True) for part in self._parts(queries, MOST_CELLS)])
        return tasks.groupBy("query_id").agg(F.sum("held").alias("held"), F.sum("scored").alias("scored"))

    def _parts(self, queries: DataFrame, most_cells: int) -> list[DataFrame]:
        (asked,) = kept(queries.sparkSession, asked=query_tokens(queries))
        size = asked.agg(F.count_distinct("token").alias("tokens"), F.count_distinct("query_id").alias("queries")).first()
        n = max(1, math.ceil(size["tokens"] * size["queries"] / most_cells))
        return [asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i) for i in range(n)]

    def _found(self, part: DataFrame, k: int, tally: bool = False) -> DataFrame:
        words, ids, counts = asked_matrix(part.collect())  # bounded by ``most_cells``
        if self.words is not None and not self.words.issuperset(words):
            raise ValueError("the index was made for other queries")
        corpus = self.cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total") / F.sum("n"), F.lit(0.0)).alias("avgdl")).first()
        df = np.zeros(len(words))
        for row in self.cells.select("tokens", "ends").mapInArrow(_frequencies(words), "code int, df long").groupBy("code").agg(F.sum("df").alias("df")).collect():  # one row a token
            df[row["code"]] = row["df"]
        asked = _Asked(words, ids, counts, np.log((corpus["n"] - df + 0.5) / (df + 0.5) + 1.0), corpus["avgdl"])
        of = {f.name: f.dataType for f in self.cells.schema.fields}
        kinds = [("query_id", part.schema["query_id"].dataType), ("chunk_id", of["chunk_ids"].elementType), ("repo_id", of["repo_ids"].elementType), ("score", T.DoubleType())]
        schema = T.StructType([T.StructField(*x) for x in kinds])
        floors = self._floors(asked, k, schema)
        if tally:
            schema = T.StructType([schema[0], T.StructField("held", T.LongType()), T.StructField("scored", T.LongType())])
        return self.cells.mapInArrow(_best(asked, floors, k, None, schema, tally), schema)

    def _floors(self, asked: _Asked, k: int, schema: T.StructType) -> np.ndarray:
        """Scores that the k-th best of each query reaches: the k-th best of its most promising cells, or 0."""
        floors = np.zeros(len(asked.ids))
        bounds = self.cells.select("cell", "tokens", "most", "least").mapInArrow(_promising(asked, FIRST), "q int, cell long, bound double")
        firsts = bounds.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct("bound", "cell")), asc=False), 1, FIRST).alias("best"))  # FIRST rows a task
        only: dict[int, list[int]] = {}
        for row in firsts.collect():  # FIRST cells a query
            for best in row["best"]:
                only.setdefault(best["cell"], []).append(row["q"])
        if not only:
            return floors
        some = top(self.cells.where(F.col("cell").isin(list(only))).mapInArrow(_best(asked, floors, k, only, schema), schema), k)
        places = {q: i for i, q in enumerate(asked.ids)}
        for row in some.where(F.col("rank") == k).select("query_id", "score").collect():  # one row a query at most
            floors[places[row["query_id"]]] = row["score"]
        return floors
