"""Bounded-space online packing of token sequences.

Each task reads its documents once and keeps a fixed number of open windows. A document's ids are cut into
whole windows first; the rest goes into the open window that it fills best. Where it fits into none, the
fullest window takes as much of it as still fits and is emitted, full, and what is left goes on. At the
end of a task the open windows remain; these leftovers (a fixed number for each task, whatever the data)
are merged, a fixed number of tasks at a time, until one window is left, which is cut into lengths that
are powers of two and need no padding.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
)
_FIELDS = [part.split(" ")[0] for part in PIECES.split(", ")]
_ARROW = pa.schema([(name, pa.binary() if name == "ids" else pa.int64()) for name in _FIELDS])

#: Texts in these code points are split alike by both tokenizer libraries; others take the slower one.
_PLAIN = re.compile("[^\t-\r -\x7e\xa0-ɏ‐-‧€]")


class Encoder:
    """Ids of the byte-level vocabulary ``<name>.json``, with the same ranks' faster reader for plain Latin texts.

    With the faster reader, the library is loaded when the first other text comes, so a worker rarely holds both.
    """

    def __init__(self, json_path: str, ranks_path: str | None):
        from tokenizers import Tokenizer

        self.load = lambda: Tokenizer.from_file(json_path)
        self.slow = self.load()
        self.fast = None
        if ranks_path is not None:
            import tiktoken
            from public_tokenizers import PATTERN

            with open(ranks_path, "rb") as file:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
            special = {t.content: i for i, t in self.slow.get_added_tokens_decoder().items() if t.special}
            self.slow = None
            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None and not _PLAIN.search(text):
            return self.fast.encode_to_numpy(text, allowed_special="all")
        if self.slow is None:
            self.slow = self.load()
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


_encoders: dict[tuple, Encoder] = {}


def encoder(json_path: str, ranks_path: str | None) -> Encoder:
    """This process's encoder for a vocabulary."""
    key = (json_path, ranks_path)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def padding(length: int, window: int) -> int:
    """Ids of padding that a sequence of this length gets: none at a power of two, else up to the window."""
    return 0 if length & (length - 1) == 0 else window - length


class Packer:
    """Open windows of one task. ``sequence_ids`` gives the ids of the sequences that it emits."""

    def __init__(self, window: int, open_windows: int, sequence_ids: Iterator[int]):
        self.window, self.most, self.ids = window, open_windows, sequence_ids
        self.open: list[tuple[int, list]] = []  # (fill, pieces)
        self.out: list[tuple] = []

    def emit(self, pieces: list) -> None:
        sequence, offset = next(self.ids), 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, offset, None))
            offset += len(ids)

    def add(self, doc, ids: np.ndarray, start: int = 0, total: int | None = None) -> None:
        total = len(ids) if total is None else total
        at, window = 0, self.window
        while len(ids) - at >= window:
            self.emit([(doc, start + at, ids[at : at + window], total)])
            at += window
        while at < len(ids):
            left = len(ids) - at
            best = max((k for k, (fill, _) in enumerate(self.open) if fill + left <= window), key=lambda k: self.open[k][0], default=None)
            if best is None and len(self.open) < self.most:
                self.open.append((left, [(doc, start + at, ids[at:], total)]))
                return
            if best is not None:
                fill, pieces = self.open[best]
                pieces.append((doc, start + at, ids[at:], total))
                if fill + left == window:
                    del self.open[best]
                    self.emit(pieces)
                else:
                    self.open[best] = (fill + left, pieces)
                return
            fullest = max(range(len(self.open)), key=lambda k: self.open[k][0])
            fill, pieces = self.open.pop(fullest)
            pieces.append((doc, start + at, ids[at : at + window - fill], total))
            self.emit(pieces)
            at += window - fill

    def leftovers(self) -> list[tuple]:
        """Pieces of the windows that are still open, with their ids."""
        return [(doc, start, len(ids), None, total, None, None, ids.tobytes()) for _, pieces in self.open for doc, start, ids, total in pieces]

    def finish(self) -> None:
        """Cut what is open into sequences whose lengths are powers of two."""
        rest = [piece for _, pieces in self.open for piece in pieces]
        self.open = []
        size = self.window
        while rest:
            have = sum(len(p[2]) for p in rest)
            while size > have:
                size //= 2
            take, need = [], size
            while need:
                doc, start, ids, total = rest.pop(0)
                if len(ids) > need:
                    rest.insert(0, (doc, start + need, ids[need:], total))
                    ids = ids[:need]
                take.append((doc, start, ids, total))
                need -= len(ids)
            self.emit(take)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in _FIELDS]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def _numbered(level: int, part: int) -> Iterator[int]:
    """Sequence ids that no other level or task gives out."""
    k = (level << 58) + (part << 34)
    while True:
        yield k
        k += 1


def pack_documents(
    documents: DataFrame,
    json_path: str,
    ranks_path: str | None = None,
    window: int = 2048,
    open_windows: int = 16,
    last_id: int = 1,
    merged_at_once: int = 16,
) -> DataFrame:
    """Pack all documents into sequences of at most ``window`` ids; one row per piece.

    Columns: doc_id, start (the document's ids before the piece), length, ids_crc32 (of the unsigned little-endian
    32-bit ids), doc_tokens (the document's ids, ``last_id`` included), sequence_id, offset (in the sequence, gapless
    from 0). ``window`` is a power of two. Every id of a document, and the ``last_id`` behind them, lies in
    exactly one piece. All sequences are full but those that are cut from the last leftover.

    Null and empty texts are documents of one id. Repeated rows are packed as often as they come; null ids stay
    null. An empty table gives an empty result. Other columns are ignored.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(json_path, ranks_path).encode
        packer = Packer(window, open_windows, _numbered(0, TaskContext.get().partitionId()))
        end = np.array([last_id], dtype="<u4")
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.concatenate([encode(text.as_py() or "").astype("<u4", copy=False), end])
                packer.add(doc, ids)
                if len(packer.out) >= 10_000:
                    yield _batch(packer.out)
                    packer.out = []
        yield _batch(packer.out + packer.leftovers())

    packed = materialize(documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(read, PIECES))
    done = [packed.where("ids IS NULL").drop("ids")]
    rest = packed.where("ids IS NOT NULL").withColumn("part", F.spark_partition_id())
    parts, level = max(1, packed.rdd.getNumPartitions()), 0
    while True:
        level += 1
        groups = -(-parts // merged_at_once)
        merged = rest.withColumn("part", (F.col("part") / F.lit(merged_at_once)).cast("int")).groupBy("part").applyInArrow(
            _merging(window, level, last=groups == 1), f"{PIECES}, part int"
        )
        if groups > 1:
            merged = materialize(merged)
        done.append(merged.where("ids IS NULL").drop("ids", "part"))
        if groups == 1:
            break
        rest, parts = merged.where("ids IS NOT NULL"), groups
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result


def _merging(window: int, level: int, last: bool):
    """A function that packs the leftovers of one group of tasks into as few windows as they need."""

    def merge(rows: pa.Table) -> pa.Table:
        part = rows.column("part")[0].as_py()
        packer = Packer(window, 1, _numbered(level, part))
        pieces = rows.select(["doc_id", "start", "doc_tokens", "ids"]).to_pylist()
        for p in sorted(pieces, key=lambda p: (p["doc_id"] is not None, p["doc_id"] or 0, p["start"], -len(p["ids"]), p["ids"])):
            packer.add(p["doc_id"], np.frombuffer(p["ids"], dtype="<u4"), p["start"], p["doc_tokens"])
        if last:
            packer.finish()
        out = pa.Table.from_batches([_batch(packer.out + packer.leftovers())])
        return out.append_column("part", pa.array([part] * len(out), pa.int32()))

    return merge
