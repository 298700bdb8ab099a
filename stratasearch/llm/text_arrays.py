"""Texts of a batch as flat numpy arrays: bytes, words and word hashes, without a Python step per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: The bytes between words, ``\\x20`` and ``\\x09-\\x0D``.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True
_TO_LOWER = np.arange(256, dtype=np.uint8)
_TO_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed 64-bit numbers that look random."""
    k = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(k + np.uint64(seed * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF))


_BYTE = stream(11, 256)
_place = stream(12, 1024) | np.uint64(1)


def _places(n: int) -> np.ndarray:
    """A factor for each position in a word; the table grows to the longest word seen."""
    global _place
    if n > len(_place):
        _place = stream(12, 1 << (n - 1).bit_length()) | np.uint64(1)
    return _place


def chunks(texts: list[str | None], most_bytes: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Encoded texts in runs of about ``most_bytes`` (a longer text is a run of its own), with the index of the first."""
    run, size, first = [], 0, 0
    for k, text in enumerate(texts):
        data = (text or "").encode("utf-8")
        if run and size + len(data) > most_bytes:
            yield first, run
            run, size, first = [], 0, k
        run.append(data)
        size += len(data)
    if run:
        yield first, run


class Words:
    """Words of a run of texts: ``text`` (index of the text), ``start``, ``end`` (in ``buffer``) and ``hash`` of each word."""

    def __init__(self, texts: list[bytes], lower: bool):
        buffer = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        if lower:
            buffer = _TO_LOWER[buffer]
        self.buffer = buffer
        self.text_start = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        space = _IS_SPACE[buffer]
        before = np.concatenate([[True], space[:-1]])
        inside = np.flatnonzero(~space)
        self.start = np.flatnonzero(before & ~space)
        self.end = np.flatnonzero(space & ~before)
        self.text = np.searchsorted(self.text_start, self.start, side="right") - 1
        lengths = self.end - self.start
        if len(self.start) == 0:
            self.hash = np.zeros(0, dtype=np.uint64)
            return
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        place = np.arange(len(inside)) - np.repeat(first, lengths)
        value = _BYTE[buffer[inside]] * _places(int(lengths.max()))[place]
        self.hash = mix(np.add.reduceat(value, first) + lengths.astype(np.uint64))
