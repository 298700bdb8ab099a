"""The line field: exact sums on small chains, held-out accuracy, odd rows."""

import itertools

import numpy as np

from stratasearch.llm import quality_crf
from stratasearch.llm.queries import op9_quality


def test_forward_backward_is_exact():
    rng = np.random.default_rng(3)
    field = quality_crf.Field(rng.standard_normal(3), rng.standard_normal((2, 2)))
    lengths = np.array([1, 4, 2, 3])
    features = rng.standard_normal((lengths.sum(), 3))
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    good, pairs, log_z = field.lattice(features, first, lengths)
    want, want_pairs, total = np.zeros(len(features)), np.zeros((2, 2)), 0.0
    for a, n in zip(first, lengths):
        e = features[a : a + n] @ field.weights
        weights = {}
        for labels in itertools.product((0, 1), repeat=int(n)):
            x = sum(e[k] for k in range(n) if labels[k]) + sum(field.steps[i, j] for i, j in zip(labels, labels[1:]))
            weights[labels] = np.exp(x)
        z = sum(weights.values())
        total += np.log(z)
        for labels, w in weights.items():
            want[a : a + n] += np.array(labels) * w / z
            for i, j in zip(labels, labels[1:]):
                want_pairs[i, j] += w / z
    assert np.allclose(good, want) and np.allclose(pairs, want_pairs) and np.isclose(log_z, total)


def test_features_of_lines():
    features, text, weight = quality_crf.line_features([b"Plain words here.\nSHOUT!! SHOUT!!", b"", "É é".encode()])
    assert text.tolist() == [0, 0, 1, 2] and weight.tolist() == [18.0, 16.0, 1.0, 6.0]
    names = list(quality_crf.OWN)
    assert features[1, names.index("capitals")] == 1 and features[1, names.index("doubled words")] == 1
    assert features[3, names.index("capitals")] == 0.5 and features[2, names.index("blank")] == 1
    ahead = len(names) + len(quality_crf.SHARED)
    assert np.allclose(features[0, ahead : ahead + len(quality_crf.SHARED)], features[1, 1 : 1 + len(quality_crf.SHARED)])
    assert features.shape[1] == quality_crf.N_FEATURES


def test_held_out_accuracy(spark):
    directory = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{directory}/labels.parquet")
    scored = op9_quality(spark, directory).join(labels, "doc_id").where("held_out").collect()
    label = np.array([r["quality"] for r in scored])
    score = np.array([r["score"] for r in scored])
    predicted = np.array([r["predicted"] for r in scored])
    order = score.argsort().argsort()
    good = label.sum()
    auc = (order[label == 1].sum() - good * (good - 1) / 2) / (good * (len(label) - good))
    assert auc > 0.99 and (predicted == label).mean() > 0.98 and (predicted[label == 1] == 1).mean() > 0.99


def test_labels_never_reach_held_out_rows(spark, data):
    """Changing the held-out labels changes no score."""
    documents, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    from pyspark.sql import functions as F

    hidden = quality_crf.held_out(F.col("doc_id"))
    flipped = labels.withColumn("quality", F.when(hidden, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (quality_crf.score_documents(documents, x).orderBy("doc_id").collect() for x in (labels, flipped))
    assert one == two and any(r["held_out"] for r in one)


def test_odd_rows(spark):
    junk = "\n".join(["SPAM!! SPAM!! SPAM!!"] * 5)
    plain = "Some quiet words of text that go on.\nAnd another line of them follows."
    rows = [(k, junk if k % 2 else plain, 1) for k in range(60)] + [(100, None, 1), (101, "", 1), (None, plain, 1), (102, "x" * 200_000, 1), (103, "\n" * 500, 1)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(k, 1 - k % 2, None) for k in range(60)] + [(5, None, 1), (None, 1, 1), (7, 9, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_crf.score_documents(documents, labels).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values())
    assert got[1]["predicted"] == 0 and got[2]["predicted"] == 1 and got[None]["held_out"] is False
    kept = quality_crf.keep_good(documents, labels)
    assert kept.columns == documents.columns and 1 not in {r["doc_id"] for r in kept.collect()}
    none = quality_crf.score_documents(documents, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality_crf.score_documents(documents.limit(0), labels).count() == 0


def test_sample_is_bounded_by_rows(spark):
    """Repeated ids give one row each."""
    from stratasearch.llm import quality_crf

    docs = spark.createDataFrame([(k % 7, f"text {k}") for k in range(3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k % 7, 1) for k in range(50)], "doc_id long, quality int")
    assert len(quality_crf.training_sample(docs, labels, max_rows=3)) <= 3
    sample = quality_crf.training_sample(docs, labels)
    assert len(sample) == sample["doc_id"].nunique() and len(sample) <= 7
