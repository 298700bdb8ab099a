"""Plain Python forms of the text functions, for code that runs inside Arrow functions.

``token_lists`` cuts many texts at once: bytes are told apart by a table, and only distinct identifiers are split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .text import CAMEL_PART, IDENTIFIER, PLAIN_WORD

#: By byte: whether it may be in an identifier, and whether one may begin with it.
_INSIDE, _FIRST = (np.array([b < 128 and bool(re.fullmatch(IDENTIFIER, front + chr(b))) for b in range(256)]) for front in ("_", ""))
#: Bytes of the texts that are cut at once, where a task bounds its memory: cutting takes some twenty times as much.
TEXT_BLOCK = 4 << 20
_IDENTIFIER, _PART = re.compile(IDENTIFIER), re.compile(CAMEL_PART)


def identifier_parts(token: str) -> list[str]:
    """The lower-cased identifier and, if there are several, its parts."""
    whole = token.lower()
    found = [p for p in whole.split("_") if p] if "_" in token else [p.lower() for p in _PART.findall(token)]
    return [whole] + (found if len(found) > 1 else [])


def tokenize(text: str | None) -> list[str]:
    """Tokens of a text."""
    return [part for token in _IDENTIFIER.findall(text or "") for part in identifier_parts(token)]


def identifiers(texts: pa.StringArray) -> pa.ListArray:
    """What ``IDENTIFIER`` finds in each text, in order; a null text has none."""
    spaced = pc.binary_join_element_wise(pc.fill_null(texts.cast(pa.string()), ""), "", " ")  # no identifier goes on into the next text
    _, at, data = spaced.buffers()
    at = np.frombuffer(at, np.int32)[: len(spaced) + 1] if len(spaced) else np.zeros(1, np.int32)
    data = np.frombuffer(data, np.uint8)[: at[-1]] if at[-1] else np.zeros(0, np.uint8)
    step = np.diff(_INSIDE[data].view(np.int8), prepend=np.int8(0))
    begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    number = np.flatnonzero(~_FIRST[data[begin]])  # digits before the first letter belong to none
    first = np.append(np.flatnonzero(np.diff(_FIRST[data].view(np.int8), prepend=np.int8(0)) == 1), len(data))
    begin[number] = first[np.searchsorted(first, begin[number])]
    begin, end = begin[begin < end], end[begin < end]
    step = np.zeros(len(data), np.int8)
    step[begin], step[end] = 1, -1
    offsets = np.append(0, np.cumsum(end - begin)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(data[np.cumsum(step, dtype=np.int8).view(bool)]))
    return pa.ListArray.from_arrays(np.searchsorted(begin, at).astype(np.int32), words)


def token_lists(texts: pa.StringArray) -> pa.ListArray:
    """Tokens of each text, as places in a dictionary of those that occur (some are in it more than once)."""
    found = identifiers(texts)
    at, words = found.offsets.to_numpy(), found.values.dictionary_encode()
    code, words = words.indices.to_numpy(), words.dictionary
    several = np.flatnonzero(~pc.match_substring_regex(words, PLAIN_WORD).to_numpy(zero_copy_only=False))
    parts = [identifier_parts(w)[1:] for w in words.take(pa.array(several)).to_pylist()]
    size = np.ones(len(words), np.int64)
    size[several] += np.array([len(p) for p in parts], np.int64)
    start = np.cumsum(size) - size
    own = np.zeros(size.sum(), bool)
    own[start] = True
    flat = np.where(own, np.cumsum(own) - 1, len(words) - 1 + np.cumsum(~own))  # an identifier as a whole, then its parts
    behind = np.append(0, np.cumsum(size[code]))  # tokens before each identifier
    places = flat[np.repeat(start[code] - behind[:-1], size[code]) + np.arange(behind[-1])]
    tokens = pa.concat_arrays([pc.ascii_lower(words), pa.array([x for p in parts for x in p], pa.string())])
    return pa.ListArray.from_arrays(behind[at].astype(np.int32), pa.DictionaryArray.from_arrays(places, tokens))


def text_blocks(batch: pa.RecordBatch, column: int, most: int = TEXT_BLOCK) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, in order, whose texts have up to ``most`` bytes together; a longer text is a part of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    until, at = np.cumsum(size, dtype=np.int64), 0
    while at < batch.num_rows:
        n = max(1, int(np.searchsorted(until, (until[at - 1] if at else 0) + most, "right")) - at)
        yield batch.slice(at, n)
        at += n
