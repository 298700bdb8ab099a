"""Token counts by byte-pair merging with a heap over a linked list.

A word starts as one symbol for each byte (the last one with the end-of-word mark). All adjacent pairs that
have a merge wait in a heap by (rank, position). The lowest is popped again and again; a popped pair that is
still there is merged: its left symbol takes the new one, the right symbol leaves the linked list, and the
two new neighbour pairs go into the heap. The count is the number of initial symbols minus the number of
merges; no identifiers are made. A word of n bytes takes O(n log n), however long it is.

Words repeat, so each Python worker remembers the counts of a bounded number of words.

Texts are cut into words here as long as they keep to Latin letters. What is a letter, a number or a capital elsewhere depends on the
version of Unicode, so other texts are cut by the vocabulary library's own normalizer and splitter; merging is the same for all.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

#: The contractions that the vocabulary's pattern takes as words of their own.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
#: The code points with Unicode's White_Space property.
SPACE = "\t-\r \x85\xa0  -     　"
#: Letters and numbers below U+0250, lower case or without case.
_LATIN_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_LATIN_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"

_LATIN_WORD = re.compile(
    f"{CONTRACTIONS}|[{_LATIN_LETTER}]+|[{_LATIN_NUMBER}]|[^{SPACE}{_LATIN_LETTER}{_LATIN_NUMBER}]+"
)
_BEYOND_LATIN = re.compile("[^\x00-\u024f]")
_NOT_ASCII = re.compile("[^\x00-\x7f]")
_SPACES = re.compile(f"[{SPACE}]+")

#: Words whose counts a worker remembers before it starts afresh.
REMEMBERED_WORDS = 400_000


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class WordCounter(dict):
    """Maps a word to its number of tokens and remembers it."""

    def __init__(self, path: str, remembered: int = REMEMBERED_WORDS):
        super().__init__()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocabulary = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.special = [x["content"] for x in spec["added_tokens"] if x["special"]]
        self.remembered = remembered
        alphabet = byte_alphabet()
        self.inner = [vocabulary[c] for c in alphabet]
        self.last = [vocabulary[c + self.end] for c in alphabet]
        # (left id, right id) in one integer -> rank and new id in one integer
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(vocabulary[left] << 20 | vocabulary[right], rank << 20 | vocabulary[left + right])
        self.library = Tokenizer.from_file(path)
        self.byte_of = {c: b for b, c in enumerate(alphabet)}
        self.split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))))

    def __missing__(self, word: str) -> int:
        if len(self) >= self.remembered:
            self.clear()
        n = self[word] = self.merged(word.encode("utf-8"))
        return n

    def merged(self, data: bytes) -> int:
        """Initial symbols minus merges."""
        n = len(data)
        if n < 2:
            return n
        inner, merges = self.inner, self.merges
        ids = [inner[b] for b in data]
        ids[-1] = self.last[data[-1]]
        heap = []
        for i in range(n - 1):
            found = merges.get(ids[i] << 20 | ids[i + 1])
            if found is not None:
                heap.append((found >> 20) << 32 | i)
        heapq.heapify(heap)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        done = 0
        while heap:
            top = heapq.heappop(heap)
            i = top & 0xFFFFFFFF
            left = ids[i]
            j = after[i]
            if left < 0 or j >= n:
                continue
            found = merges.get(left << 20 | ids[j])
            if found is None or found >> 20 != top >> 32:
                continue  # the pair that waited here is gone
            made = ids[i] = found & 0xFFFFF
            ids[j] = -1
            k = after[i] = after[j]
            done += 1
            if k < n:
                before[k] = i
                found = merges.get(made << 20 | ids[k])
                if found is not None:
                    heapq.heappush(heap, (found >> 20) << 32 | i)
            h = before[i]
            if h >= 0:
                found = merges.get(ids[h] << 20 | made)
                if found is not None:
                    heapq.heappush(heap, (found >> 20) << 32 | h)
        return n - done

    def words(self, text: str) -> list[str]:
        """The words of a text, normalized. Below U+0250, all versions of Unicode agree."""
        if _BEYOND_LATIN.search(text):
            text = self.library.normalizer.normalize_str(text)
            return [bytes(map(self.byte_of.__getitem__, word)).decode("utf-8") for word, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]
        if _NOT_ASCII.search(text):
            text = unicodedata.normalize("NFC", text)
        text = text.lower()
        return _LATIN_WORD.findall(text) if not _BEYOND_LATIN.search(text) else self.words(text)

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        return sum(map(self.__getitem__, self.words(text)))

    def count(self, text: str | None) -> int:
        """Tokens of a whole text; each special string in it is one token."""
        if not text:
            return 0
        if not any(s in text for s in self.special):
            return self.plain(text)
        parts = self.split.split(text)
        return len(parts) - 1 + sum(self.plain(part) for part in parts)


_counters: dict[str, WordCounter] = {}


def word_counter(path: str) -> WordCounter:
    """This process's counter for a vocabulary file; it outlives a task, as its worker does."""
    if path not in _counters:
        _counters[path] = WordCounter(path)
    return _counters[path]


def count_tokens(documents: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    ``vocabulary``: path of a byte-level vocabulary with merges and an end-of-word mark, readable on every executor.
    Null and empty texts have no bytes and no tokens. Repeated rows and null ids come back as they are, an
    empty table gives an empty result, other columns are ignored.
    """

    @F.pandas_udf(T.LongType())
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = word_counter(vocabulary)
        for texts in batches:
            yield pd.Series([counter.count(t) for t in texts], dtype="int64")

    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select(
        "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), tokens(text).alias("n_tokens")
    ).withColumn("over_limit", F.col("n_tokens") > limit)
