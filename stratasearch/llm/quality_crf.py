"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's features are shares of its characters and words (capitals, digits, symbols,
repeated words, ...) together with those of the line before and the line behind; the chain adds a weight for each
pair of neighbouring labels. Forward-backward gives each line's probability of being good, and their
mean, weighted with the lines' lengths, is the document's quality; two numbers fitted on the training documents
turn it into the probability of label 1.

The field is trained on a bounded sample of labelled documents (every line has its document's label) by exact
gradients on the driver; scoring is one pass over the documents without a shuffle. Labels, language, source and
id are never features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text_arrays import Words, chunks

#: Features of a line that its neighbours see too.
SHARED = ("capitals", "digits", "symbols", "bars", "bangs", "other marks", "doubled words", "repeated words")
OWN = ("one", *SHARED, "log words", "word length", "blank")
N_FEATURES = len(OWN) + 2 * len(SHARED)

_CLASSES = 9
_CLASS = np.full(256, 8, dtype=np.int64)  # 0 continuation, 1 capital, 2 lower, 3 digit, 4 symbol, 5 bar, 6 bang, 7 space, 8 other mark
_CLASS[0x80:0xC0] = 0
_CLASS[0xC0:] = 2
_CLASS[65:91] = 1
_CLASS[97:123] = 2
_CLASS[48:58] = 3
_CLASS[[ord(c) for c in "#$%&*@^~=_+<>{}[]\\/"]] = 4
_CLASS[ord("|")] = 5
_CLASS[ord("!")] = 6
_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 7


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of some texts, each line's text, and each line's weight (its length and one)."""
    words = Words(texts, lower=False)
    buffer = words.buffer
    ends = np.flatnonzero(buffer == 10)  # every text ends with a line end of its own
    n = len(ends)
    starts = np.concatenate([[0], ends[:-1] + 1])
    lengths = ends - starts
    text = np.searchsorted(words.text_start, starts, side="right") - 1
    kind = _CLASS[buffer]
    capital = (buffer[1:] >= 0x80) & (buffer[1:] <= 0x9E) & (buffer[:-1] == 0xC3)  # capitals of Latin-1
    kind[:-1][capital] = 1
    kind[1:][capital] = 0
    line_of_byte = np.repeat(np.arange(n), lengths + 1)
    count = np.bincount(line_of_byte * _CLASSES + kind, minlength=n * _CLASSES).reshape(n, _CLASSES).astype(np.float64)
    count[:, 7] -= 1  # the line end itself
    letters = np.maximum(count[:, 1] + count[:, 2], 1)
    size = np.maximum(count[:, 1:7].sum(axis=1) + count[:, 8], 1)

    line = np.searchsorted(ends, words.start, side="left")
    n_words = np.bincount(line, minlength=n)
    same = np.zeros(n)
    fresh = np.zeros(n)
    if len(line):
        twin = (words.hash[1:] == words.hash[:-1]) & (line[1:] == line[:-1])
        same = np.bincount(line[1:][twin], minlength=n)
        order = np.lexsort((words.hash, line))
        by_line, by_hash = line[order], words.hash[order]
        new = np.concatenate([[True], (by_line[1:] != by_line[:-1]) | (by_hash[1:] != by_hash[:-1])])
        fresh = np.bincount(by_line[new], minlength=n)
    several = np.maximum(n_words, 1)
    shared = np.stack(
        [
            count[:, 1] / letters,
            np.minimum(1, 3 * count[:, 3] / size),
            np.minimum(1, 6 * count[:, 4] / size),
            np.minimum(1, 12 * count[:, 5] / size),
            np.minimum(1, 12 * count[:, 6] / size),
            np.minimum(1, 4 * count[:, 8] / size),
            np.minimum(1, 2 * same / several),
            np.clip(2 * (0.6 - fresh / several), 0, 1) * (n_words > 4),
        ],
        axis=1,
    )
    own = [np.ones(n), *shared.T, np.log1p(n_words) / 4, np.minimum(size / several, 20) / 10, (n_words == 0).astype(float)]
    behind = np.zeros_like(shared)
    ahead = np.zeros_like(shared)
    joined = text[1:] == text[:-1]
    behind[1:][joined] = shared[:-1][joined]
    ahead[:-1][joined] = shared[1:][joined]
    return np.concatenate([np.stack(own, axis=1), behind, ahead], axis=1), text, lengths + 1.0


@dataclass
class Field:
    """Weights of good against bad for each feature, for each pair of labels in a row, and the final two numbers."""

    weights: np.ndarray
    steps: np.ndarray  # [label before, label], 1 is good
    scale: float = 8.0
    shift: float = -4.0

    def lattice(self, features: np.ndarray, first: np.ndarray, lengths: np.ndarray):
        """Forward-backward over all chains at once.

        Chains are handled from the longest to the shortest, so those that still go on at a step are the first
        ones. Returns P(good) of every line, the expected number of label pairs, and the log of the partition function.
        """
        emission = features @ self.weights
        n, order = len(emission), np.argsort(-lengths, kind="stable")
        first, lengths = first[order], lengths[order]
        longest = int(lengths[0])
        active = np.searchsorted(-lengths, -np.arange(longest), side="left")  # chains with more than t lines
        forward = np.empty((n, 2))
        step = self.steps
        for t in range(longest):
            at = first[: active[t]] + t
            e = emission[at]
            if t == 0:
                forward[at, 0], forward[at, 1] = 0.0, e
            else:
                back = forward[at - 1]
                forward[at, 0] = np.logaddexp(back[:, 0] + step[0, 0], back[:, 1] + step[1, 0])
                forward[at, 1] = np.logaddexp(back[:, 0] + step[0, 1], back[:, 1] + step[1, 1]) + e
        backward = np.zeros((n, 2))
        last = first + lengths - 1
        log_z_chain = np.logaddexp(forward[last, 0], forward[last, 1])
        log_z = np.empty(n)
        log_z[np.concatenate([first[: active[t]] + t for t in range(longest)])] = np.concatenate([log_z_chain[: active[t]] for t in range(longest)])
        pairs = np.zeros((2, 2))
        for t in range(longest - 2, -1, -1):
            at = first[: active[t + 1]] + t
            e = emission[at + 1]
            ahead = backward[at + 1]
            zero, one = ahead[:, 0], ahead[:, 1] + e
            backward[at, 0] = np.logaddexp(step[0, 0] + zero, step[0, 1] + one)
            backward[at, 1] = np.logaddexp(step[1, 0] + zero, step[1, 1] + one)
            here, z = forward[at], log_z[at]
            for a in (0, 1):
                for b, to in ((0, zero), (1, one)):
                    pairs[a, b] += np.exp(here[:, a] + step[a, b] + to - z).sum()
        good = np.exp(forward[:, 1] + backward[:, 1] - log_z)
        return np.clip(good, 0, 1), pairs, log_z_chain.sum()

    def quality(self, texts: list[bytes]) -> np.ndarray:
        """Length-weighted mean of the marginals of each text."""
        features, text, weight = line_features(texts)
        lengths = np.bincount(text, minlength=len(texts))
        good, _, _ = self.lattice(features, np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
        return np.bincount(text, weight * good, minlength=len(texts)) / np.bincount(text, weight, minlength=len(texts))

    def score(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.quality(texts) + self.shift)))


def _adam(start: np.ndarray, gradient, rounds: int, rate: float) -> np.ndarray:
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for k in range(1, rounds + 1):
        g = gradient(x)
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        x -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
    return x


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-6, rounds: int = 100) -> tuple[float, float]:
    """Slope and intercept of a logistic fit by Newton's method; the ridge keeps it finite where x separates the labels."""
    z = np.array([8.0, -4.0])
    inputs = np.stack([x, np.ones_like(x)], axis=1)
    keep = np.diag([ridge, ridge])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(inputs @ z, -30, 30)))
        slope = inputs.T @ (p - y) / len(y) + keep @ z
        bend = (inputs * (p * (1 - p))[:, None]).T @ inputs / len(y) + keep
        step = np.linalg.solve(bend, slope)
        z = z - step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
    return float(z[0]), float(z[1])


def train(texts: list[str | None], labels: list[int], rounds: int = 400, rate: float = 0.2, penalty: float = 1e-4) -> Field:
    """Fit a field. Both labels weigh the same in all; without labelled texts of both kinds every text scores 0.5."""
    y = np.array(labels, dtype=np.float64)
    if len(set(labels)) < 2:
        return Field(np.zeros(N_FEATURES), np.zeros((2, 2)), 0.0, 0.0)
    parts, at = [], 0
    for _, run in chunks(texts):
        features, text, weight = line_features(run)
        parts.append((features, text + at, weight))
        at += len(run)
    features = np.concatenate([p[0] for p in parts])
    text = np.concatenate([p[1] for p in parts])
    weight = np.concatenate([p[2] for p in parts])
    lengths = np.bincount(text, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    target = features.T @ y[text]
    seen = np.zeros((2, 2))
    for label in (0, 1):
        seen[label, label] = (lengths[y == label] - 1).sum()

    def gradient(x: np.ndarray) -> np.ndarray:
        field = Field(x[:-4], x[-4:].reshape(2, 2))
        good, pairs, _ = field.lattice(features, first, lengths)
        g = np.concatenate([features.T @ good - target, (pairs - seen).ravel()]) / len(features)
        return g + penalty * x

    x = _adam(np.zeros(N_FEATURES + 4), gradient, rounds, rate)
    field = Field(x[:-4], x[-4:].reshape(2, 2))
    good, _, _ = field.lattice(features, first, lengths)
    quality = np.bincount(text, weight * good) / np.bincount(text, weight)

    field.scale, field.shift = _logistic(quality, y)
    return field


def held_out(doc_id) -> F.Column:
    """Rows that training never sees: crc32 of the id as text leaves 0 when divided by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(documents: DataFrame, labels: DataFrame, max_rows: int = 4000, max_chars: int = 20_000) -> pd.DataFrame:
    """At most ``max_rows`` labelled texts (text, quality) outside the held-out rows, none longer than ``max_chars``.

    The ids are chosen first, by a hash, so the join with the texts broadcasts ``max_rows`` ids at most; of several rows of an id the least text counts.
    """
    chosen = (
        labels.where("doc_id IS NOT NULL AND quality IN (0, 1)")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.char_length("text") <= max_chars)
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    return found.select("doc_id", "text", "quality").toPandas().sort_values("doc_id", ignore_index=True)


def fit(documents: DataFrame, labels: DataFrame, max_rows: int = 4000) -> Field:
    """Train a field on the bounded sample."""
    sample = training_sample(documents, labels, max_rows)
    return train(sample["text"].tolist(), sample["quality"].astype(int).tolist())


def score_column(field: Field):
    """A column function: the score of a text."""

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = np.zeros(len(texts))
            for first, run in chunks(texts.tolist()):
                out[first : first + len(run)] = field.score(run)
            yield pd.Series(out)

    return score


def score_documents(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 4000) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 if score >= threshold).

    Null texts count as empty; an empty text is one empty line and has a score like any other. A null doc_id is not
    held out. Labels that are null or neither 0 nor 1 are not used; of several labels of an id the greater counts. Without
    usable labels of both kinds every score is 0.5. Repeated rows come back as often as they come; an empty table gives
    an empty result; other columns are ignored.
    """
    score = score_column(fit(documents, labels, max_rows))
    return documents.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.coalesce("text", F.lit(""))).alias("score")
    ).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 4000) -> DataFrame:
    """The rows of ``documents`` that score at least ``threshold``, with all their columns. See ``score_documents``."""
    score = score_column(fit(documents, labels, max_rows))
    return documents.where(score(F.coalesce("text", F.lit(""))) >= threshold)
