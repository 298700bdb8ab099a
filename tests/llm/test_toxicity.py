import itertools
import random
import zlib

import numpy as np
import pytest

from stratasearch.llm import toxicity
from stratasearch.llm.queries import QUERIES
from stratasearch.llm.text_arrays import Words
from stratasearch.llm.toxicity import ABSTAIN, NO, VOTERS, YES, LabelModel, Voters


def votes_of(text):
    votes, _, _ = Voters().look([text])
    return {name: int(v) for name, v in zip(VOTERS, votes[0]) if v != ABSTAIN}


def test_voters():
    said = votes_of("well, you idiot. what a loser")
    assert said["mind"] == said["worth"] == said["near a pronoun"] == said["several"] == YES and "no insult" not in said
    assert votes_of("you 1d1ot")["masked"] == YES and "no insult" not in votes_of("you 1d1ot")
    assert "near a pronoun" not in votes_of("you one two three idiot") and votes_of("idiot… tu")["near a pronoun"] == YES
    assert votes_of("")["no insult"] == votes_of("plain words")["no insult"] == NO
    assert votes_of("ESTÚPIDO")["mind"] == YES and votes_of("so baaad")["stretched"] == YES


def test_votes_do_not_depend_on_the_batch():
    random.seed(3)
    texts = ["", "you idiot", "x" * 5000, "é" * 3, "idiot", "\n\n", "trash you", None, "1di0t you scum scum", "!!! WHAT !!! NO"] * 3
    random.shuffle(texts)
    plain = [t or "" for t in texts]
    both, _, _ = Voters().look(plain)
    assert (both == np.concatenate([Voters().look([t])[0] for t in plain])).all()
    assert [len(r) for _, r in toxicity.runs(texts, 10)] and [t for _, r in toxicity.runs(texts, 10) for t in r] == plain


def test_stems_are_first_letters():
    words = Words(["réeuxme réeuxpa abc réeu rée réezz".encode()], lower=False)
    index, hashes = toxicity.stems(words, 4)
    assert index.tolist() == [0, 1, 3, 5]
    assert hashes[0] == hashes[1] == hashes[2] != hashes[3]


def test_label_model_equals_enumeration():
    """Posterior by the model's own tables, summed directly, and their normalisation over all votes."""
    rng = np.random.default_rng(2)
    hidden = rng.random(500) < 0.3
    first = np.where(rng.random(500) < 0.8, np.where(hidden, YES, NO), ABSTAIN)
    votes = np.stack([first, np.where(rng.random(500) < 0.9, first, NO), np.where(hidden == (rng.random(500) < 0.85), YES, NO)], axis=1)
    model = LabelModel()
    posterior = model.fit(votes)
    total = 0.0
    for combo in itertools.product(range(3), repeat=3):
        joint = []
        for y, prior in ((0, 1 - model.prior), (1, model.prior)):
            p = prior
            for j, v in enumerate(combo):
                parent = model.parents[j]
                p *= model.tables[j][y, combo[parent] if parent >= 0 else 0, v]
            joint.append(p)
        total += sum(joint)
        rows = (votes == combo).all(axis=1)
        assert np.allclose(posterior[rows], joint[1] / sum(joint), atol=1e-4)
    assert abs(total - 1) < 1e-9
    assert model.parents[1] == 0  # the copy of the first voter hangs on it


def test_accuracies_are_found_without_labels():
    rng = np.random.default_rng(7)
    hidden = rng.random(4000) < 0.4
    truth = [0.9, 0.8, 0.7, 0.85, 0.6]
    votes = np.stack([np.where(rng.random(4000) < 0.6, np.where((rng.random(4000) < a) == hidden, YES, NO), ABSTAIN) for a in truth], axis=1)
    model = LabelModel()
    posterior = model.fit(votes)
    assert np.abs(model.accuracies() - truth).max() < 0.06
    best = np.where((votes == YES).sum(1) == (votes == NO).sum(1), hidden, (votes == YES).sum(1) > (votes == NO).sum(1))
    assert ((posterior > 0.5) == hidden).mean() >= (best == hidden).mean() - 0.08


def test_copies_of_a_voter_do_not_count_twice():
    """Five copies of a poor voter must not outvote three good ones."""
    rng = np.random.default_rng(9)
    hidden = rng.random(3000) < 0.5
    good = [np.where((rng.random(3000) < 0.9) == hidden, YES, NO) for _ in range(3)]
    poor = np.where((rng.random(3000) < 0.6) == hidden, YES, NO)
    votes = np.stack([*good, *[poor] * 5], axis=1)
    trusted = LabelModel(trusted=0)
    assert ((trusted.fit(votes) > 0.5) == hidden).mean() > 0.93
    assert sum(p >= 3 for p in trusted.parents[4:]) == 4


def test_mined_words_and_mild_words():
    random.seed(1)
    plain = [f"w{k}" for k in range(300)]
    texts, labels = [], []
    for k in range(400):
        bad = k % 8 == 0
        words = random.choices(plain, k=40) + (["flurb"] if bad else []) + (["trash"] if k % 3 == 0 else [])
        random.shuffle(words)
        texts.append(" ".join(words))
        labels.append(int(bad))
    model = toxicity.train(texts, labels)
    flurb, trash = (Words([w], lower=False).hash[0] for w in (b"flurb", b"trash"))
    assert flurb in np.concatenate(model.voters.mined) and trash in model.voters.mild and trash not in model.voters.insults
    scores = model.score(["w1 w2 flurb w3 " * 3, "w1 w2 w3 trash", ""])
    assert scores[0] > 0.5 > scores[1] and scores[2] < 0.5


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 0.5, True) for r in rows], "doc_id long, text string, score string, predicted double, held_out boolean")


def test_odd_rows(spark):
    rows = [(1, "you idiot"), (1, "you idiot"), (2, None), (3, ""), (None, "nice words"), (4, "idiot " + "fine words " * 60_000)]
    docs = frame(spark, rows).repartition(3)
    labels = spark.createDataFrame([(k, k % 2, "a") for k in range(5)] + [(1, None, "b"), (None, 1, "c"), (3, 7, "d")], "doc_id long, toxic int, text string")
    got = toxicity.score_documents(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    out = got.collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert toxicity.score_documents(docs.limit(0), labels).collect() == []
    unfitted = {r.doc_id: r.predicted for r in toxicity.score_documents(docs, labels.limit(0)).collect()}
    assert unfitted == {1: 1, 2: 0, 3: 0, None: 0, 4: 1}
    assert toxicity.keep_clean(docs, labels.limit(0)).columns == docs.columns


def test_sample_is_bounded_by_rows(spark):
    docs = frame(spark, [(k % 7, f"text {k}") for k in range(3000)])
    labels = spark.createDataFrame([(k % 7, 1) for k in range(50)], "doc_id long, toxic int")
    assert len(toxicity.training_sample(docs, labels, max_rows=3)) <= 3
    assert len(toxicity.training_sample(docs, labels)) == sum(zlib.crc32(str(k).encode()) % 5 != 0 for k in range(7))


@pytest.mark.parametrize("scale,least", [("0.01", 0.95), ("0.1", 0.98)])
def test_held_out_accuracy(spark, scale, least):
    sf = f"/root/testdata/sf{scale}"
    found = QUERIES["op12_toxicity"](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id")
    right = found.selectExpr("avg(cast(predicted = toxic as int)) a", "sum(case when predicted = 1 and toxic = 0 then 1 else 0 end) f", "count(*) n").first()
    assert right.a >= least and right.f <= 0.01 * right.n
