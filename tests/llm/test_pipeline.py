"""The stages of the corpus pipeline against direct versions, each on its own input."""

import numpy as np
import public_tokenizers
from test_minhash_join import brute_force
from test_native import copies
from test_packing import check
from tokenizers import Tokenizer

import corpus_pipeline
from stratasearch.llm import quality_crf


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, data)
        out.write.parquet(str(tmp_path / str(number)))
        result = spark.read.parquet(str(tmp_path / str(number)))
        if number < 3:
            assert result.columns == columns
            kept = {r["doc_id"] for r in result.collect()}
        if number == 0:
            field = quality_crf.fit(docs, spark.read.parquet(f"{data}/labels.parquet"))
            scores = field.score([t.encode() for t in rows.values()])
            assert kept == {d for d, x in zip(rows, scores) if x >= 0.3} and np.isfinite(scores).all()
        elif number == 1:
            assert kept == {r[0] for r in copies(list(rows.items())) if r[3]}
        elif number == 2:
            assert kept == {d for d, (_, c) in brute_force(list(rows.items()), 5, 80).items() if d == c}
        else:
            library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            check(result.collect(), {d: [library.encode(t, add_special_tokens=False).ids + [1]] for d, t in rows.items()}, 2048)
        docs = result


def test_run(spark, data):
    found = corpus_pipeline.run(spark, data)
    assert found.columns[:2] == ["doc_id", "start"] and found.count() > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "near dedup", "packing"]
