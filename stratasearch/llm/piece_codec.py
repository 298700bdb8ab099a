"""SentencePiece encoding and decoding in one pass with a bounded window.

The recurrence runs over the end positions of a text: for each position it keeps one backpointer, the last
piece of the best segmentation of the text up to there. As no piece is longer than a fixed number of
characters, only that many positions can still be reached from; whenever the backpointer paths of all of
them meet in one boundary, the ids before it are committed and forgotten. Texts of any length take a
window of memory.

The public model's pieces are ranked merges (byte-pair type), so "best" is not the greatest sum of scores, as it
would be for a unigram model, but the segmentation that merging by rank gives. That has the same optimal
substructure: a segmentation is right exactly if each two neighbouring pieces are what merging gives for
the two of them alone, and hence every position has exactly one last piece. The check of a pair takes the place of
the maximum over scores; the ids equal the library's.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
#: Words and pairs of pieces that a worker remembers before it starts afresh.
REMEMBERED_WORDS = 1_000_000
REMEMBERED_PAIRS = 1_000_000
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
#: Pieces have a space mark at their start only, so merges never cross a word's end.
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
#: The same, cut behind each run of letters; for vocabularies without a piece that goes on there.
_LETTERS = re.compile(f"{SPACE}*[^{SPACE}{_LETTER}]*[{_LETTER}]+|{SPACE}+[^{SPACE}{_LETTER}]*|[^{SPACE}{_LETTER}]+")


class Codec(dict):
    """Ids of a model file of byte-pair type with byte fallback. As a mapping: a word -> its ids as bytes, remembered."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.rank = {self.pieces[i]: -model.get_score(i) for i in plain}
        self.byte = {int(self.pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.is_byte = np.zeros(n, dtype=bool)
        self.is_byte[list(self.byte_of)] = True
        self.longest = max(map(len, self.rank))
        if any(SPACE in p.lstrip(SPACE) for p in self.rank):
            raise ValueError("a piece goes beyond a word's end")
        # every ending of a piece -> the id of the ending itself, or -1 where it is no piece
        self.ending = {p[k:]: -1 for p in self.rank for k in range(len(p))}
        self.ending |= {self.pieces[i]: i for i in plain}
        # neighbours inside some piece; between other characters every path has a boundary
        self.joined = {p[k : k + 2] for p in self.rank for k in range(len(p) - 1)}
        letter = re.compile(f"[{_LETTER}]")
        across = any(letter.match(a) and not letter.match(b) for a, b in self.joined)
        self.word = _WORD if across else _LETTERS
        self.alone: dict[int, bool] = {}
        self.pairs: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """Merging by rank, for short strings."""
        n = len(text)
        symbol: list[str | None] = list(text)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        rank = self.rank
        heap = [(rank[text[i : i + 2]], i, text[i : i + 2]) for i in range(n - 1) if text[i : i + 2] in rank]
        heapq.heapify(heap)
        while heap:
            _, i, made = heapq.heappop(heap)
            j = after[i] if symbol[i] is not None else n
            if j >= n or symbol[i] + symbol[j] != made:
                continue
            symbol[i], symbol[j] = made, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if made + symbol[k] in rank:
                    heapq.heappush(heap, (rank[made + symbol[k]], i, made + symbol[k]))
            h = before[i]
            if h >= 0 and symbol[h] + made in rank:
                heapq.heappush(heap, (rank[symbol[h] + made], h, symbol[h] + made))
        return [s for s in symbol if s is not None]

    def spelled(self, token: int) -> str:
        """A token's characters; numbers beyond the vocabulary stand for single characters outside of it."""
        return self.pieces[token] if token < self.size else chr(token - self.size)

    def stands_alone(self, token: int) -> bool:
        """Whether merging a piece's characters gives the piece."""
        found = self.alone.get(token)
        if found is None:
            piece = self.spelled(token)
            found = self.alone[token] = self.merged(piece) == [piece]
        return found

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the characters of two tokens gives just the two tokens."""
        if len(self.pairs) >= REMEMBERED_PAIRS:
            self.pairs.clear()
        a, b = self.spelled(left), self.spelled(right)
        found = self.pairs[left << 21 | right] = self.merged(a + b) == [a, b]
        return found

    def stream(self, characters: str) -> Iterator[list[int]]:
        """Tokens of a word in runs, committed as soon as they are certain."""
        ending, pairs, longest = self.ending, self.pairs, self.longest
        base = 0  # the committed boundary
        token, length = [-1], [0]  # the last token of the text up to base, base + 1, ... and its length
        n = len(characters)
        for end in range(1, n + 1):
            choices = []
            start, least = end - 1, max(base, end - longest)
            while start >= least:
                found = ending.get(characters[start:end])
                if found is None:
                    break
                if found >= 0:
                    choices.append((start, found))
                start -= 1
            if not choices or choices[0][0] != end - 1:  # a character that is no piece
                choices.insert(0, (end - 1, self.size + ord(characters[end - 1])))
            for start, choice in reversed(choices):
                left = token[start - base]
                if left < 0:
                    right = self.stands_alone(choice)
                else:
                    right = pairs.get(left << 21 | choice)
                    if right is None:
                        right = self.fits(left, choice)
                if right:
                    token.append(choice)
                    length.append(end - start)
                    break
            if end - base >= 4 * longest and end < n:
                meet = self._meeting(length, end - base)
                if meet:
                    yield self._path(token, length, meet)
                    base, token, length = base + meet, token[meet:], length[meet:]
        yield self._path(token, length, n - base)

    @staticmethod
    def _path(token: list[int], length: list[int], at: int) -> list[int]:
        """The tokens that the backpointers name, up to a position."""
        path = []
        while at > 0:
            path.append(token[at])
            at -= length[at]
        path.reverse()
        return path

    def _meeting(self, length: list[int], end: int) -> int:
        """The last boundary that the paths of all positions that can still be reached from go through."""
        open_ends = set(range(end - self.longest + 1, end + 1))
        while len(open_ends) > 1:
            far = max(open_ends)
            open_ends.remove(far)
            open_ends.add(max(0, far - length[far]))
        return open_ends.pop()

    def parts(self, word: str) -> list[str]:
        """A word cut where no piece can reach across."""
        joined = self.joined
        cuts = [k for k in range(1, len(word)) if word[k - 1 : k + 1] not in joined]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])]

    def __missing__(self, word: str) -> bytes:
        parts = self.parts(word)
        if len(parts) > 1:
            return b"".join(map(self.__getitem__, parts))
        out: list[int] = []
        for run in self.stream(word):
            if max(run) < self.size:
                out += run
            else:
                for token in run:
                    out += [token] if token < self.size else [self.byte[b] for b in chr(token - self.size).encode("utf-8")]
        found = np.array(out, dtype="<i4").tobytes()
        if len(word) <= 64:
            if len(self) >= REMEMBERED_WORDS:
                self.clear()
            self[word] = found
        return found

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit numbers: spaces become marks, and one goes before the text."""
        if not text:
            return b""
        return b"".join(map(self.__getitem__, self.word.findall(SPACE + text.replace(" ", SPACE))))

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        return np.frombuffer(self.encode_bytes(text), dtype="<i4").tolist()

    def decode(self, ids) -> str:
        """The text of some ids; bytes that are no UTF-8 become U+FFFD."""
        ids = np.asarray(ids, dtype=np.int64)
        pieces = self.pieces
        if not self.is_byte[ids].any():
            return "".join(map(pieces.__getitem__, ids.tolist())).replace(SPACE, " ").removeprefix(" ")
        parts: list[str] = []
        data = bytearray()
        for i in ids.tolist():
            if i in self.byte_of:
                data.append(self.byte_of[i])
                continue
            if data:
                parts.append(data.decode("utf-8", "replace"))
                data.clear()
            parts.append(pieces[i])
        if data:
            parts.append(data.decode("utf-8", "replace"))
        return "".join(parts).replace(SPACE, " ").removeprefix(" ")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """This process's codec for a model file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_documents(documents: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids array<int>, ids_crc32) of every row; a null or empty text has no ids.

    The checksum is of the ids as little-endian 32-bit numbers. ``model``: path of a model of byte-pair type, readable on every
    executor. Repeated rows and null ids come back as they are; an empty table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(model).encode_bytes
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists = [encode(t or "") for t in part.column(1).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in lists])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(lists), dtype="<i4")))
                sums = pa.array([zlib.crc32(x) for x in lists], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), ids, sums], names=["doc_id", "ids", "ids_crc32"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, ids array<int>, ids_crc32 long")


def decode_ids(encoded: DataFrame, model: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of rows with ``ids``, and the ``text`` of the ids; null ids give an empty text."""
    kept = encoded.select(*keep, "ids")
    schema = T.StructType([*kept.schema.fields[:-1], T.StructField("text", T.StringType())])
    names = [*keep, "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = codec(model).decode
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = part.column(len(keep))
                texts = [decode(x.values.to_numpy(zero_copy_only=False) if x.is_valid else []) for x in ids]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(texts, pa.string())], names=names)

    return kept.mapInArrow(run, schema)
