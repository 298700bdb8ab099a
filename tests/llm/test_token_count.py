"""Token counts against the vocabulary's own library."""

import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stratasearch.llm import token_count

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    library = Tokenizer.from_file(PATH)
    counter = token_count.WordCounter(PATH, remembered=50)
    return counter, lambda text: len(library.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(both, text):
    counter, library = both
    assert counter.count(text) == library(text)


def test_every_character(both):
    """Each code point beside letters, numbers and marks, in blocks."""
    counter, library = both
    points = [c for c in range(1, 0x32000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 200):
        text = " ".join(f"a{chr(c)}B{chr(c)}{chr(c)}1" for c in points[at : at + 200])
        assert counter.count(text) == library(text)


@pytest.mark.parametrize(
    "text",
    [
        "<|endoftext|>", "a<|startoftext|>b <|endoftext|>", "It's 1234 o'clock -- WE'LL SEE", "ΑΣ ΣΑΣ ς", "İstanbul ß ﬁ ²³ ¼", "a" * 5000, "ab" * 3000 + "!" * 2000,
        "\x1c\x85\u2028 x", "e\u0301cole \u00e9cole", "日本語 한국어 🙂🙂", "\U00018ef3a \U00018d1d\u0301 \U00016ff2x \ua7cb\ua7cc", "İI i̇ ŒŸ", "K Å Ω",
    ],
)
def test_odd_texts(both, text):
    counter, library = both
    assert counter.count(text) == library(text)


def test_whole_table(spark, data, both):
    documents = spark.read.parquet(f"{data}/documents.parquet")
    texts = dict(documents.select("doc_id", "text").collect())
    for row in token_count.count_tokens(documents, PATH).collect():
        assert row["n_tokens"] == both[1](texts[row["doc_id"]])
        assert row["n_bytes"] == len(texts[row["doc_id"]].encode()) and row["over_limit"] == (row["n_tokens"] > 2048)


def test_odd_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (2, "", 5), (None, "two words", 5)]
    got = token_count.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), PATH, 1).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 0, 0, False), (2, 0, 0, False), (2, 0, 0, False), (None, 9, 2, True)], key=str)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_count.count_tokens(empty, PATH).count() == 0


def test_merging_counts_merges(both):
    counter, library = both
    rng = random.Random(3)
    for _ in range(200):
        word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 30)))
        assert counter.merged(word.encode()) == library(word)
