"""Toxicity by weak supervision: many unreliable voters, a generative model of their votes, a linear classifier.

Voters are lexicons (themes of fixed words; words and word stems mined from the labelled sample by greedy cover) and patterns
(an insult near a pronoun, several insults, masked letters, shouting, stretched letters, no insult at all, ...). Each votes toxic or clean
for a text, or abstains. A word counts wherever it is; a stem, as other words may share it, where it is dense. The label of a training row is one more voter that may be wrong.

The label model has a hidden class for each text. Given the class, each voter depends on at most one other voter: the pairs
with the greatest conditional mutual information form a tree, so voters that see the same thing don't count twice.
Expectation maximisation estimates the votes' probabilities (the voters' accuracies) and with them the posterior of every
sampled text. A logistic classifier over votes, hits and words is trained on those posteriors and scores all texts in one pass without a shuffle.

Labels, language, source and id are never features. The sample is bounded by rows and by characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality_crf import held_out
from .text_arrays import _BYTE, Words, _places, mix, stream

#: Words of contempt by theme, in the languages of the documents.
THEMES = {
    "mind": "idiot idiots moron morons stupid imbecile dumb fool cretin halfwit dimwit dunce clown dummkopf trottel blödmann vollidiot débile crétin imbécile abruti bouffon estúpido estúpida tonto idiota payaso",
    "worth": "worthless pathetic loser losers useless failure nobody wertlos erbärmlich versager nutzlos minable raté inútil perdedor fracasado patético",
    "filth": "scum trash garbage filth vermin disgusting vile abschaum müll dreck ekelhaft widerlich ungeziefer ordure racaille dégoûtant vermine basura escoria asqueroso asquerosa",
    "threat": "kill murder destroy hurt strangle umbringen töten verprügeln tuer massacrer frapper matar golpear destrozar",
    "hate": "hate despise loathe shut hasse verachte hais méprise odio desprecio cállate",
}
#: Words for the person spoken to.
ADDRESS = "you your youre du dich dein deine ihr euch tu toi ton ta vous votre usted eres tú vosotros"

MINED = 3
#: Letters of a stem, and the share of a text's words from which on a stem is dense there (two at least).
STEMS, DENSE = (4, 6), 0.008
PATTERNS = ("stems together", "near a pronoun", "several", "dense", "masked", "shouting", "stretched")
CLEAN = ("no insult", "long without insult", "calm", "no bang")
VOTERS = (*THEMES, *[f"mined {k}" for k in range(1, MINED + 1)], *[f"stems {k}" for k in range(1, MINED + 1)], *PATTERNS, *CLEAN)
ABSTAIN, NO, YES = 0, 1, 2

_NOT_LETTERS = bytes(c if 97 <= c <= 122 or c >= 0x80 else 32 for c in range(256))
_UNMASK = bytearray(_NOT_LETTERS)
for _sign, _letter in zip(b"013457@$", b"oieastas", strict=True):
    _UNMASK[_sign] = _letter
_MASKED = re.compile(rb"[a-z][013457@$]+[a-z]")
_STRETCHED = re.compile(rb"([a-z])\1\1")
#: Fixed value: Latin-1 marks and general punctuation in UTF-8, which divide words as ASCII marks do.
_MARKS = re.compile(rb"\xc2[\xa0-\xbf]|\xe2[\x80\x81][\x80-\xbf]")
_CAPITALS = bytes(range(65, 91))
_LETTERS = _CAPITALS + bytes(range(97, 123))


def _hashes(words: str) -> np.ndarray:
    return np.unique(Words([words.encode()], lower=False).hash)


def _lowered(text: str) -> bytes:
    return _MARKS.sub(b" ", text.lower().encode("utf-8", "replace"))


def _within(hashes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each hash in the sorted ``wanted``, or -1."""
    if not len(wanted):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)
    return np.where(wanted[at] == hashes, at, -1)


def stems(words: Words, letters: int) -> tuple[np.ndarray, np.ndarray]:
    """Words with that many letters at least (their index), and a hash of their first letters."""
    first = np.flatnonzero((words.buffer & 0xC0) != 0x80)
    at = np.searchsorted(first, words.start) + letters
    end = np.where(at < len(first), first[np.minimum(at, len(first) - 1)], len(words.buffer))
    own = np.flatnonzero(end <= words.end)
    start, end = words.start[own], end[own]
    value = np.full(len(own), letters, dtype=np.uint64)
    place = _places(4 * letters)
    for k in range(4 * letters):
        inside = start + k < end
        if not inside.any():
            break
        value[inside] += _BYTE[words.buffer[start[inside] + k]] * place[k]
    return own, mix(mix(value))


def runs(texts: list[str | None], most_chars: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """Texts (null: empty) in runs of about ``most_chars``, with the index of the first."""
    run: list[str] = []
    size = 0
    for k, text in enumerate(texts):
        run.append(text or "")
        size += len(run[-1])
        if size >= most_chars:
            yield k + 1 - len(run), run
            run, size = [], 0
    if run:
        yield len(texts) - len(run), run


def dense_in(hits: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Two hits at least, and DENSE of the words."""
    return (hits >= 2) & (hits >= DENSE * words)


@dataclass
class Voters:
    """The voters with their lexicons; ``mined`` are word hashes, a sorted array for each mined lexicon, and ``stems`` those of stems; ``mild`` are left out of the themes."""

    mined: list[np.ndarray] = field(default_factory=lambda: [np.zeros(0, dtype=np.uint64)] * MINED)
    stems: list[np.ndarray] = field(default_factory=lambda: [np.zeros(0, dtype=np.uint64)] * MINED)
    mild: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.uint64))

    def __post_init__(self):
        themes = {name: np.setdiff1d(_hashes(words), self.mild) for name, words in THEMES.items()}
        self.lexicons = [*themes.values(), *self.mined, *self.stems]
        self.insults = np.unique(np.concatenate([themes["mind"], themes["worth"], themes["filth"], *self.mined]))
        self.address = _hashes(ADDRESS)

    def look(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, Words]:
        """Votes (texts, voters), evidence of each lexicon (texts, lexicons), and the words of the texts."""
        n, n_lexicons = len(texts), len(self.lexicons)
        lowered = [_lowered(t) for t in texts]
        words = Words([t.translate(_NOT_LETTERS) for t in lowered], lower=False)
        per_text = np.bincount(words.text, minlength=n)
        hits = np.zeros((n, n_lexicons))
        for k, own in enumerate(self.lexicons[:-MINED]):
            hits[:, k] = np.bincount(words.text[_within(words.hash, own) >= 0], minlength=n)
        starts = [stems(words, letters) for letters in STEMS]
        dense = np.zeros((n, MINED + 1), dtype=bool)
        every = np.zeros(len(words.hash), dtype=bool)
        for k, own in enumerate(self.stems):
            found = np.zeros(len(words.hash), dtype=bool)
            for index, hashes in starts:
                found[index[_within(hashes, own) >= 0]] = True
            hits[:, k - MINED] = np.bincount(words.text[found], minlength=n)
            dense[:, k] = dense_in(hits[:, k - MINED], per_text)
            every |= found
        dense[:, MINED] = dense_in(np.bincount(words.text[every], minlength=n), per_text)
        insult = np.flatnonzero(_within(words.hash, self.insults) >= 0)
        insults = np.bincount(words.text[insult], minlength=n)
        addressed = np.zeros(n, dtype=bool)
        person = np.zeros(len(words.hash) + 6, dtype=bool)
        person[3:-3] = _within(words.hash, self.address) >= 0
        owner = np.full(len(person), -1)
        owner[3:-3] = words.text
        for shift in range(-3, 4):
            near = insult[person[insult + 3 + shift] & (owner[insult + 3 + shift] == words.text[insult])]
            addressed[words.text[near]] = True
        masked = np.zeros(n, dtype=bool)
        some = [k for k, t in enumerate(lowered) if _MASKED.search(t)]
        if some:
            again = Words([lowered[k].translate(bytes(_UNMASK)) for k in some], lower=False)
            found = np.bincount(again.text[_within(again.hash, self.insults) >= 0], minlength=len(some))
            masked[some] = found > insults[some]
        data = [t.encode("utf-8", "replace") for t in texts]
        capitals = np.array([len(t) - len(t.translate(None, _CAPITALS)) for t in data])
        letters = np.array([len(t) - len(t.translate(None, _LETTERS)) for t in data])
        loud = capitals > 0.5 * np.maximum(letters, 1)
        bangs = np.array([t.count(b"!") for t in data])
        stretched = np.array([_STRETCHED.search(t) is not None for t in lowered])
        yes = [*(hits[:, :-MINED] > 0).T, *dense.T, addressed, insults > 1, insults > 0.02 * np.maximum(per_text, 1), masked, loud & (bangs > 2), stretched]
        none = (insults == 0) & ~masked & ~dense.any(axis=1)
        no = [none, none & (per_text >= 100), ~loud & (capitals < 0.2 * np.maximum(letters, 1)), bangs == 0]
        votes = np.stack([*[np.where(x, YES, ABSTAIN) for x in yes], *[np.where(x, NO, ABSTAIN) for x in no]], axis=1)
        evidence = np.log1p(hits)
        evidence[:, -MINED:] = np.minimum(1, 50 * hits[:, -MINED:] / np.maximum(per_text, 1)[:, None])
        return votes, evidence, words


def signs(words: Words, n: int, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a lexicon may hold: distinct (text, word) and (text, dense stem) pairs as text, hash and whether it is a stem."""
    per_text = np.bincount(words.text, minlength=n)
    out = []
    for stem, (text, key) in [(False, (words.text, words.hash)), *[(True, (words.text[at], h)) for at, h in (stems(words, k) for k in STEMS)]]:
        order = np.lexsort((key, text))
        text, key = text[order], key[order]
        new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (key[1:] != key[:-1])])[: len(text)])
        count = np.diff(np.append(new, len(text)))
        text, key = text[new], key[new]
        if stem:
            dense = dense_in(count, per_text[text])
            text, key = text[dense], key[dense]
        out.append((text + first, key, np.full(len(text), stem)))
    text, key, stem = (np.concatenate([x[k] for x in out]) for k in range(3))
    return text, key, stem


def mine_lexicons(text: np.ndarray, key: np.ndarray, toxic: np.ndarray, half: np.ndarray, most: int = 200) -> np.ndarray:
    """Words and stems by greedy cover of the toxic texts; the pairs (text, hash) must be distinct.

    A sign must be in three toxic texts at least, and in four times as many toxic as clean ones, in both halves of the sample (``half`` is 0 or 1 for each text). The
    next one is that in most toxic texts that hold no chosen sign yet: in five at least, and in more than the best of all
    would be by chance.
    """
    known, at = np.unique(key, return_inverse=True)
    precise = np.ones(len(known), dtype=bool)
    for side in (0, 1):
        own = half[text] == side
        df = np.bincount(at[own], minlength=len(known))
        in_toxic = np.bincount(at[own], toxic[text[own]], minlength=len(known))
        precise &= (in_toxic >= 3) & (df - in_toxic <= 0.2 * df)
    open_texts, chosen = toxic.astype(bool), []
    use = precise[at] & open_texts[text]
    text, at = text[use], at[use]
    while len(chosen) < most and len(text):
        gain = np.bincount(at, minlength=len(known))
        best = int(gain.argmax())
        share = max(open_texts.mean(), 1 / len(toxic))
        if gain[best] < 5 or gain[best] * np.log(1 / share) < np.log(len(known)) + 5:
            break
        chosen.append(known[best])
        open_texts[text[at == best]] = False
        use = open_texts[text]
        text, at = text[use], at[use]
    return np.array(chosen, dtype=np.uint64)


def mild_words(text: np.ndarray, word: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Theme words that are in three texts of the sample at least, and mostly in clean ones: other words of the same spelling."""
    themes = _hashes(" ".join(THEMES.values()))
    at = _within(word, themes)
    text, at = text[at >= 0], at[at >= 0]
    df = np.bincount(at, minlength=len(themes))
    return themes[(df >= 3) & (np.bincount(at, toxic[text], minlength=len(themes)) < 0.5 * df)]


class LabelModel:
    """P(votes, class) where each voter depends on the class and on at most one other voter."""

    def __init__(self, trusted: int | None = None, rounds: int = 50):
        self.trusted, self.rounds = trusted, rounds
        self.prior = 0.5
        self.parents: list[int] = []
        self.tables: list[np.ndarray] = []  # [class, vote of the parent, vote]

    def _believed(self, voter: int, n: int) -> np.ndarray:
        """Counts added before estimating: a vote is rather right than wrong, the trusted voter's more firmly so."""
        weight = max(2.0, 0.05 * n) if voter == self.trusted else 2.0
        added = np.ones((2, 3))
        added[0, NO] = added[1, YES] = weight
        return added

    def _estimate(self, votes: np.ndarray, posterior: np.ndarray) -> None:
        n, m = votes.shape
        weight = np.stack([1 - posterior, posterior])
        self.prior = float((posterior.sum() + 1) / (n + 2))
        self.tables = []
        for j in range(m):
            parent = self.parents[j]
            above = votes[:, parent] if parent >= 0 else np.zeros(n, dtype=int)
            seen = np.stack([np.bincount(above * 3 + votes[:, j], w, minlength=9).reshape(3, 3) for w in weight])
            alone = seen.sum(axis=1) + self._believed(j, n)
            alone /= alone.sum(axis=1, keepdims=True)
            seen += 5 * alone[:, None, :]  # rare votes of the parent fall back on the voter alone
            self.tables.append(seen / seen.sum(axis=2, keepdims=True))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(toxic | votes)."""
        odds = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for j, table in enumerate(self.tables):
            above = votes[:, self.parents[j]] if self.parents[j] >= 0 else 0
            odds += np.log(table[1, above, votes[:, j]]) - np.log(table[0, above, votes[:, j]])
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))

    def dependence(self, votes: np.ndarray, posterior: np.ndarray) -> np.ndarray:
        """Conditional mutual information of each pair of voters given the class, in nats."""
        n, m = votes.shape
        flags = np.concatenate([votes == v for v in range(3)], axis=1).astype(float)
        total = np.zeros((m, m))
        for weight in (1 - posterior, posterior):
            share = weight.sum() / n
            both = (flags * weight[:, None]).T @ flags / max(weight.sum(), 1e-9)
            one = np.diag(both)
            ratio = np.where(both > 1e-12, both * np.log(np.maximum(both, 1e-12) / np.maximum(np.outer(one, one), 1e-12)), 0.0)
            total += share * ratio.reshape(3, m, 3, m).sum(axis=(0, 2))
        np.fill_diagonal(total, 0)
        if self.trusted is not None:  # its errors are taken to be its own, else it would explain the others away
            total[self.trusted] = total[:, self.trusted] = 0
        return total

    def _tree(self, strength: np.ndarray, least: float) -> list[int]:
        """Parents in a forest of the strongest pairs over ``least``, grown from the first voter of each tree."""
        m = len(strength)
        parents, inside = [-1] * m, np.zeros(m, dtype=bool)
        while not inside.all():
            edge = np.where(inside[:, None] & ~inside[None, :], strength, -1)
            a, b = np.unravel_index(edge.argmax(), edge.shape)
            if edge[a, b] > least:
                parents[b], inside[b] = int(a), True
            else:
                inside[np.flatnonzero(~inside)[0]] = True
        return parents

    def fit(self, votes: np.ndarray) -> np.ndarray:
        """Estimate everything from votes alone; returns the posteriors.

        The tree comes from a first guess of the classes (the trusted voter, or shares of votes) and is drawn anew once they are estimated.
        Independent voters would not do for a start: a voter with copies would be the class.
        """
        n = len(votes)
        posterior = (0.5 + (votes == YES).sum(axis=1)) / (1 + (votes != ABSTAIN).sum(axis=1))
        if self.trusted is not None:
            own = votes[:, self.trusted]
            posterior = np.where(own == ABSTAIN, posterior, np.where(own == YES, 0.9, 0.1))
        for _ in range(2):
            self.parents = self._tree(self.dependence(votes, posterior), 10.0 / n)
            for _ in range(self.rounds):
                self._estimate(votes, posterior)
                new = self.posterior(votes)
                done = np.abs(new - posterior).max() < 1e-6
                posterior = new
                if done:
                    break
        return posterior

    def accuracies(self) -> np.ndarray:
        """P(vote is right | it votes) for voters without a parent's vote, for reports; classes weigh by the prior."""
        share = np.array([1 - self.prior, self.prior])
        out = []
        for table in self.tables:
            alone = table.mean(axis=1)
            right = share[0] * alone[0, NO] + share[1] * alone[1, YES]
            out.append(right / max(right + share[0] * alone[0, YES] + share[1] * alone[1, NO], 1e-12))
        return np.array(out)


@dataclass
class Classifier:
    """A logistic classifier over votes, hits and the presence of chosen words."""

    voters: Voters
    words: np.ndarray  # sorted hashes
    weights: np.ndarray

    @classmethod
    def unfitted(cls) -> Classifier:
        """Without labelled texts: the fixed lexicons of contempt alone decide."""
        voters = Voters()
        weights = np.zeros(1 + len(VOTERS) + len(voters.lexicons))
        weights[0] = -4.0
        weights[[1 + VOTERS.index(name) for name in ("mind", "worth", "filth")]] = 8.0
        return cls(voters, np.zeros(0, dtype=np.uint64), weights)

    def inputs(self, texts: list[str]) -> np.ndarray:
        votes, evidence, words = self.voters.look(texts)
        n = len(texts)
        at = _within(words.hash, self.words)
        pairs = np.unique(words.text[at >= 0] * max(len(self.words), 1) + at[at >= 0])
        there = np.zeros((n, len(self.words)))
        if len(self.words):
            there[pairs // len(self.words), pairs % len(self.words)] = 1
            there /= np.sqrt(np.maximum(there.sum(axis=1, keepdims=True), 1))
        return np.concatenate([np.ones((n, 1)), votes != ABSTAIN, evidence, there], axis=1)

    def score(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.inputs(texts) @ self.weights, -40, 40)))

    def learn(self, inputs: np.ndarray, target: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> None:
        """Newton's method on the posteriors as targets; the intercept isn't shrunk."""
        w = np.zeros(inputs.shape[1])
        keep = np.full(len(w), ridge)
        keep[0] = 1e-3
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(inputs @ w, -40, 40)))
            slope = inputs.T @ (p - target) + keep * w
            bend = (inputs * (p * (1 - p))[:, None]).T @ inputs + np.diag(keep)
            step = np.linalg.solve(bend, slope)
            w -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w


def train(texts: list[str | None], labels: list[int], most_words: int = 400) -> Classifier:
    """Mine lexicons, fit the label model on votes and labels, and train the classifier on its posteriors."""
    if not texts:
        return Classifier.unfitted()
    toxic = np.array(labels, dtype=float)
    found = [signs(Voters().look(run)[2], len(run), first) for first, run in runs(texts)]
    text, key, stem = (np.concatenate([x[k] for x in found]) for k in range(3))
    mined = mine_lexicons(text, key, toxic, stream(21, len(texts)) & np.uint64(1))
    of_stems = np.isin(mined, key[stem])
    dealt = [[np.sort(own[k::MINED]) for k in range(MINED)] for own in (mined[~of_stems], mined[of_stems])]
    text, word = text[~stem], key[~stem]
    voters = Voters(*dealt, mild_words(text, word, toxic))
    votes = np.concatenate([voters.look(run)[0] for _, run in runs(texts)])
    votes = np.concatenate([votes, np.where(toxic > 0, YES, NO)[:, None]], axis=1)
    posterior = LabelModel(trusted=len(VOTERS)).fit(votes)
    known, at = np.unique(word, return_inverse=True)
    df, heavy = np.bincount(at), np.bincount(at, posterior[text], minlength=len(known))
    share = posterior.mean()
    surprise = np.abs(heavy - df * share) / np.sqrt(np.maximum(df * share * (1 - share), 1e-9))
    common = np.flatnonzero(df >= 5)
    chosen = common[np.argsort(-surprise[common], kind="stable")[:most_words]]
    model = Classifier(voters, np.sort(known[chosen]), np.zeros(0))
    model.learn(np.concatenate([model.inputs(run) for _, run in runs(texts)]), posterior)
    return model


def training_sample(documents: DataFrame, labels: DataFrame, max_rows: int = 4000, max_chars: int = 20_000) -> pd.DataFrame:
    """At most ``max_rows`` labelled rows (doc_id, text, toxic) outside the held-out ones, no text longer than ``max_chars``.

    Ids are chosen first, by a hash, so the join broadcasts ``max_rows`` ids at most; an id that repeats gives one row.
    """
    chosen = (
        labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.char_length("text") <= max_chars)
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return found.toPandas().sort_values("doc_id", ignore_index=True)


def fit(documents: DataFrame, labels: DataFrame, max_rows: int = 4000) -> Classifier:
    """Train on the bounded sample."""
    sample = training_sample(documents, labels, max_rows)
    return train(sample["text"].tolist(), sample["toxic"].astype(int).tolist())


def score_column(model: Classifier):
    """A column function: the score of a text."""

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            parts = [model.score(run) for _, run in runs(texts.tolist())]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return score


def score_documents(documents: DataFrame, labels: DataFrame, threshold: float = 0.5, max_rows: int = 4000) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 if score >= threshold).

    Whole texts are scored, of any length; null texts count as empty, and an empty text has a score like any other. A null doc_id is not
    held out. Labels that are null or neither 0 nor 1 are not used; of several labels of an id the greater counts, and of
    several rows of an id the least text is trained on. Without usable labels the fixed lexicons alone decide. Repeated rows come back as
    often as they come; an empty table gives an empty result; other columns are ignored.
    """
    score = score_column(fit(documents, labels, max_rows))
    return documents.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.coalesce("text", F.lit(""))).alias("score")
    ).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def keep_clean(documents: DataFrame, labels: DataFrame, threshold: float = 0.5, max_rows: int = 4000) -> DataFrame:
    """The rows of ``documents`` that score below ``threshold``, with all their columns. See ``score_documents``."""
    score = score_column(fit(documents, labels, max_rows))
    return documents.where(score(F.coalesce("text", F.lit(""))) < threshold)
