"""Line dedup by winnowing over line hashes.

A run of consecutive lines counts as repeated text when it has at least ``least_words`` words and the same lines came
before, in an earlier document or further up. Later copies of such runs are deleted.

1. Every line with words becomes a hash of its words (A-Z lower-cased, white space between words ignored); a blank line only counts
   as a gap before the next one.
2. A window is the shortest run of lines with enough words that begins, or that ends, at a line. Its minimum, the leftmost line with the
   least hash, is its fingerprint. Only these positions are selected, about one for each window's length. Every repeated run holds a whole
   window, so both copies have the same fingerprint at the same place: none is missed. A position carries the lines around it that a
   window can reach, ``least_words`` words to each side at most.
3. Fingerprints are counted with a map-side combination; those that occur once, most of them, go no further.
4. Every other position is joined with the first one of its fingerprint, and the match is extended line by line to the front and to the
   back. With enough words, the lines of the later position are deleted.
5. Windows of a position that the first occurrence doesn't hold may still be those of another position: their contents are hashed,
   with those of the first occurrences, and the earliest of each content stays. Longer runs are put together from the matches at their
   fingerprints, which overlap.

Positions are never paired with each other, only with the first one, so a line that is everywhere costs its number of
occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_up_to, materialize, unused_name
from .text_arrays import Words, chunks, mix

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_GAP = np.uint64(0xD6E8FEB86659FD93)
#: A line of a context: its hash, its words, the blank lines before it.
UNIT = np.dtype([("hash", "<u8"), ("words", "<i4"), ("gap", "<i4")])
#: Low bits that hold a line's index where windows look for their least hash.
_INDEX = np.uint64((1 << 28) - 1)
_POSITIONS = "doc_id long, line int, fingerprint long, at int, context binary"
_FOUND = "doc_id long, first int, last int, fingerprint long, content long"
#: Documents with deleted lines whose spans are broadcast; for more, the texts are shuffled.
MOST_BROADCAST = 100_000
#: Spans of them (of 24 bytes, and 8 for their place), and bytes of the contexts of first occurrences, that are broadcast.
MOST_SPANS, MOST_CONTEXT = 1_000_000, 32_000_000
#: Shared fingerprints, of 16 bytes, that are broadcast.
MOST_FINGERPRINTS = 500_000


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def text_lines(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lines with words of some texts: UNIT rows, each line's text, and its place in that text."""
    words = Words(texts, lower=True)
    ends = np.flatnonzero(words.buffer == 10)
    n = len(ends)
    starts = np.concatenate([[0], ends[:-1] + 1])
    text = np.searchsorted(words.text_start, starts, side="right") - 1
    line = np.searchsorted(ends, words.start, side="left")
    n_words = np.bincount(line, minlength=n)
    first_word = np.cumsum(n_words) - n_words
    place = np.arange(len(line)) - np.repeat(first_word, n_words)
    full = np.flatnonzero(n_words)
    units = np.zeros(len(full), UNIT)
    if len(full):
        value = mix(words.hash + place.astype(np.uint64) * _GAP)
        units["hash"] = mix(np.add.reduceat(value, first_word[full]) + n_words[full].astype(np.uint64))
    units["words"] = n_words[full]
    own = text[full]
    inside = full - np.searchsorted(text, np.arange(len(texts)), side="left")[own]
    units["gap"][1:] = np.where(own[1:] == own[:-1], np.diff(full) - 1, 0)
    return units, own, inside


def windows(units: np.ndarray, owner: np.ndarray, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First line, last line and minimum of every window inside the lines of one owner; owners are runs."""
    n = len(units)
    before = np.concatenate([[0], np.cumsum(units["words"], dtype=np.int64)])
    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate([starts, [n]]))
    lowest, after = np.repeat(starts, sizes), np.repeat(starts + sizes, sizes)
    k = np.arange(n)
    stop = np.searchsorted(before, before[:-1] + least_words, side="left")  # windows that begin at each line
    forward = stop <= after
    begin = np.searchsorted(before, before[1:] - least_words, side="right") - 1  # windows that end at each line
    backward = begin >= lowest
    pairs = np.concatenate([np.stack([k[forward], stop[forward]], axis=1), np.stack([begin[backward], k[backward] + 1], axis=1)])
    if len(pairs) == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    pairs = np.unique(pairs, axis=0)
    order = np.concatenate([(units["hash"] & ~_INDEX) | k.astype(np.uint64), [np.uint64(0)]])
    least = np.minimum.reduceat(order, pairs.ravel())[::2]
    return pairs[:, 0], pairs[:, 1] - 1, (least & _INDEX).astype(np.int64)


def _contents(units: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of the lines and the gaps between them of each run."""
    value = mix(units["hash"] + (units["gap"].astype(np.uint64) + np.uint64(1)) * _GAP)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * _powers(_BASE, len(units)))])
    inner = (total[last + 1] - total[first + 1]) * _powers(_INVERSE, len(units))[first]
    return mix(mix(units["hash"][first]) + inner + (last - first).astype(np.uint64)).view(np.int64)


def _selected(least_words: int):
    """The selected positions of texts, each with its context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at, part in chunks(batch.column(1).to_pylist()):
                units, text, line = text_lines(part)
                position = np.unique(windows(units, text, least_words)[2])
                before = np.concatenate([[0], np.cumsum(units["words"], dtype=np.int64)])
                first = np.searchsorted(text, text[position], side="left")
                last = np.searchsorted(text, text[position], side="right") - 1
                low = np.maximum(first, np.searchsorted(before, before[position] - least_words, side="right") - 1)
                high = np.minimum(last, np.searchsorted(before, before[position + 1] + least_words, side="left") - 1)
                size = high - low + 1
                offsets = np.concatenate([[0], np.cumsum(size)])
                lines = units[np.repeat(low - offsets[:-1], size) + np.arange(offsets[-1])]
                context = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int64) * UNIT.itemsize), pa.py_buffer(lines.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[at:][text[position]].astype(np.int64)),
                        pa.array(line[position].astype(np.int32)),
                        pa.array(units["hash"][position].view(np.int64)),
                        pa.array((position - low).astype(np.int32)),
                        context.cast(pa.binary()),
                    ],
                    names=["doc_id", "line", "fingerprint", "at", "context"],
                )

    return run


class _Contexts:
    """The contexts of a batch, one after the other; ``at`` is the index of each position."""

    def __init__(self, at: pa.Array, context: pa.Array):
        rows = context.to_pylist()
        self.units = np.frombuffer(b"".join(rows), UNIT)
        self.size = np.array([len(r) // UNIT.itemsize for r in rows], dtype=np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.end = self.first + self.size
        self.at = self.first + at.to_numpy(zero_copy_only=False)
        self.owner = np.repeat(np.arange(len(rows)), self.size)
        self.row = np.cumsum(self.units["gap"].astype(np.int64) + 1)  # line numbers, up to a constant for each context


def _extended(left: _Contexts, right: _Contexts) -> tuple[np.ndarray, np.ndarray]:
    """How many lines before and after its position each context has in common with its partner."""
    back, ahead = np.zeros(len(left.at), np.int64), np.zeros(len(left.at), np.int64)
    a, b = left.units, right.units
    go, k = np.arange(len(left.at)), 0
    while len(go):
        k += 1
        go = go[(left.at[go] + k < left.end[go]) & (right.at[go] + k < right.end[go])]
        x, y = left.at[go] + k, right.at[go] + k
        go = go[(a["hash"][x] == b["hash"][y]) & (a["gap"][x] == b["gap"][y])]
        ahead[go] = k
    go, k = np.arange(len(left.at)), 0
    while len(go):
        k += 1
        go = go[(left.at[go] - k >= left.first[go]) & (right.at[go] - k >= right.first[go])]
        x, y = left.at[go] - k, right.at[go] - k
        go = go[(a["hash"][x] == b["hash"][y]) & (a["gap"][x + 1] == b["gap"][y + 1])]
        back[go] = k
    return back, ahead


def _matched(least_words: int, paired: bool):
    """Rows (doc_id, line, fingerprint, at, context) and, if ``paired``, (first_at, first_context) become rows of _FOUND: the lines that the
    first occurrence shows to be a copy (content null), and the windows of the position that it doesn't hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids, line, mark = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
            here = _Contexts(batch.column(3), batch.column(4))
            low, high = here.at, here.at - 1
            spans = np.zeros(0, np.int64)
            if paired:
                back, ahead = _extended(here, _Contexts(batch.column(5), batch.column(6)))
                total = np.concatenate([[0], np.cumsum(here.units["words"], dtype=np.int64)])
                low, high = here.at - back, here.at + ahead
                spans = np.flatnonzero(total[high + 1] - total[low] >= least_words)
                high = np.where(total[high + 1] - total[low] >= least_words, high, low - 1)
            first, last, least = windows(here.units, here.owner, least_words)
            own = here.owner[first]
            open_ = (least == here.at[own]) & ~((first >= low[own]) & (last <= high[own]))
            first, last, own = first[open_], last[open_], own[open_]
            a, b, who = np.concatenate([low[spans], first]), np.concatenate([high[spans], last]), np.concatenate([spans, own])
            shift = line[who] - here.row[here.at[who]]
            content = np.concatenate([np.zeros(len(spans), np.int64), _contents(here.units, first, last)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[who]),
                    pa.array((here.row[a] + shift).astype(np.int32)),
                    pa.array((here.row[b] + shift).astype(np.int32)),
                    pa.array(mark[who]),
                    pa.array(content, mask=np.arange(len(content)) < len(spans)),
                ],
                names=["doc_id", "first", "last", "fingerprint", "content"],
            )

    return run


def repeated_runs(documents: DataFrame, least_words: int = 50) -> DataFrame:
    """(doc_id, spans) of every document with deleted lines; a span is {first, last}, lines counted from 0. Spans may overlap."""
    rows = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    positions = materialize(rows.mapInArrow(_selected(least_words), _POSITIONS))
    counted = positions.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")
    counted = materialize(counted.select("fingerprint", "first_doc"))
    shared = materialize(positions.join(broadcast_up_to(counted, MOST_FINGERPRINTS), "fingerprint"))
    firsts = materialize(
        shared.where("doc_id = first_doc").groupBy("fingerprint").agg(F.min(F.struct("doc_id", "line", "at", "context")).alias("o")).select("fingerprint", "o.*")
    )
    named = broadcast_up_to(firsts, MOST_BROADCAST, F.octet_length("context"), MOST_CONTEXT).select("fingerprint", F.col("line").alias("first_line"), F.col("at").alias("first_at"), F.col("context").alias("first_context"))
    later = shared.join(named, "fingerprint").where("doc_id > first_doc OR line > first_line")
    columns = ["doc_id", "line", "fingerprint", "at", "context"]
    found = materialize(later.select(*columns, "first_at", "first_context").mapInArrow(_matched(least_words, True), _FOUND))
    open_ = found.where("content IS NOT NULL").unionByName(firsts.select(*columns).mapInArrow(_matched(least_words, False), _FOUND))
    open_ = materialize(open_)
    place = F.struct("doc_id", "first")
    origins = open_.groupBy("content", "fingerprint").agg(F.min(place).alias("origin"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = open_.join(origins, ["content", "fingerprint"]).where(place > F.col("origin"))
    spans = found.where("content IS NULL").select("doc_id", "first", "last").unionByName(again.select("doc_id", "first", "last"))
    return spans.groupBy("doc_id").agg(F.collect_set(F.struct("first", "last")).alias("spans"))


def without_lines(text: str, spans) -> tuple[str, int]:
    """The text without the lines of the spans, and how many lines went."""
    lines = text.split("\n")
    gone = np.zeros(len(lines) + 1, dtype=np.int64)
    for span in spans:
        gone[span["first"]] += 1
        gone[span["last"] + 1] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    return "\n".join(line for line, out in zip(lines, gone) if not out), int(gone.sum())


def drop_repeated_runs(documents: DataFrame, least_words: int = 50) -> DataFrame:
    """``documents`` with the later copies of repeated runs deleted from ``text``, and a column ``removed_lines``.

    "Earlier" is the order of (doc_id, line). Null and empty texts stay as they are. Rows with a null doc_id take no part. doc_id is taken
    for a key: where rows repeat one, their lines have the same place and only whole runs of other documents count as
    earlier. A text of which nothing is left becomes empty; its row stays. An empty table gives an empty result. All columns of
    ``documents`` stay, whatever their names; where one is called ``removed_lines``, the new one is ``removed_lines_1`` (and so on).
    """

    @F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("removed", T.LongType())]))
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = [(None, 0) if s is None else without_lines(t, s) for t, s in zip(texts, spans)]
        return pd.DataFrame(rows, columns=["text", "removed"])

    names = documents.columns
    doc, spans, made, count = (unused_name(names, wish) for wish in ("doc", "spans", "cut", "removed_lines"))
    touched = broadcast_up_to(materialize(repeated_runs(documents, least_words)), MOST_BROADCAST, F.size("spans"), MOST_SPANS)
    touched = touched.select(F.col("doc_id").alias(doc), F.col("spans").alias(spans))
    both = documents.join(touched, documents["doc_id"].cast("long") == touched[doc], "left")
    result = both.withColumn(made, cut(F.when(F.col(spans).isNotNull(), F.col("text")), F.col(spans)))
    return result.select(
        *[F.coalesce(F.col(made)["text"], F.col("text")).alias("text") if c == "text" else F.col(c) for c in names],
        F.col(made)["removed"].alias(count),
    )
