"""Ids against the model's own library, and round trips."""

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from stratasearch.llm import piece_codec

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    return piece_codec.Codec(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(both, text):
    codec, library = both
    ids = codec.encode(text)
    assert ids == library.encode(text) and codec.decode(ids) == library.decode(ids)


@pytest.mark.parametrize("text", ["a" * 3000, "ab" * 2000 + " x", "的" * 500, " " * 70 + "x", "'" * 200, "<s> </s> <0x41>", "internationalization" * 40, "\x00\x01", "▁ ▁▁"])
def test_odd_texts(both, text):
    codec, library = both
    assert codec.encode(text) == library.encode(text)


def test_commits_before_the_end(both):
    """A long word comes out in several runs, and no run is longer than the window allows for."""
    codec, _ = both
    runs = list(codec.stream("▁" + "uninterruptedly" * 60))
    assert len(runs) > 5 and all(sum(len(codec.spelled(t)) for t in run) <= 4 * codec.longest for run in runs)


def test_whole_table(spark, data, both):
    documents = spark.read.parquet(f"{data}/documents.parquet")
    texts = dict(documents.select("doc_id", "text").collect())
    encoded = piece_codec.encode_documents(documents, PATH)
    for row in encoded.collect():
        assert row["ids"] == both[1].encode(texts[row["doc_id"]])
    assert {r["doc_id"]: r["text"] for r in piece_codec.decode_ids(encoded, PATH).collect()} == texts


def test_odd_rows(spark):
    rows = [(1, None, 1), (2, "", 1), (None, "x", 1), (3, "x", 1), (3, "x", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    encoded = piece_codec.encode_documents(frame, PATH)
    got = piece_codec.decode_ids(encoded, PATH).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == [("1", ""), ("2", ""), ("3", "x"), ("3", "x"), ("None", "x")]
    assert piece_codec.encode_documents(frame.limit(0), PATH).count() == 0
    nulls = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert piece_codec.decode_ids(nulls, PATH).first()["text"] == ""
