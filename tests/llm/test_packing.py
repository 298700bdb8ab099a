"""Packing: every id in exactly one piece, gapless sequences, little padding."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stratasearch.llm import packing

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=50))
def test_ids(library, text):
    assert packing.encoder(JSON, RANKS).encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_special_strings(library):
    for text in ("<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "<|endoftex", "x\x1cy\x85z 日本 🙂"):
        assert packing.encoder(JSON, RANKS).encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def check(pieces, ids, window):
    """``ids``: id lists of the documents, by doc_id; a repeated doc_id has several."""
    covered, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        covered[p["doc_id"]].append(p)
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for doc, lists in ids.items():
        want = sorted(len(x) for x in lists)
        assert sum(p["length"] for p in covered[doc]) == sum(want)
        if len(lists) == 1:
            at = 0
            for p in sorted(covered[doc], key=lambda p: p["start"]):
                part = np.array(lists[0][at : at + p["length"]], dtype="<u4")
                assert p["start"] == at and p["doc_tokens"] == want[0] and p["ids_crc32"] == zlib.crc32(part.tobytes())
                at += p["length"]
    padded = 0
    for rows in sequences.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at and length > 0
            at += length
        assert at <= window
        padded += packing.padding(at, window)
    assert padded == 0
    assert set(covered) == set(ids)


@pytest.mark.parametrize("merged_at_once", [2, 64])
def test_whole_table(spark, data, library, merged_at_once):
    documents = spark.read.parquet(f"{data}/documents.parquet").repartition(5, "doc_id")
    ids = {r["doc_id"]: [library.encode(r["text"], add_special_tokens=False).ids + [1]] for r in documents.collect()}
    pieces = packing.pack_documents(documents, JSON, RANKS, window=512, open_windows=4, merged_at_once=merged_at_once).collect()
    check(pieces, ids, 512)


def test_without_ranks(spark, library):
    frame = spark.createDataFrame([(1, "some words here"), (2, "more")], "doc_id long, text string")
    ids = {r["doc_id"]: [library.encode(r["text"], add_special_tokens=False).ids + [1]] for r in frame.collect()}
    check(packing.pack_documents(frame, JSON).collect(), ids, 2048)


def test_odd_rows(spark, library):
    long = "word " * 6000
    rows = [(1, None, 1), (2, "", 1), (3, long, 1), (None, "x y", 1), (4, "same", 1), (4, "same", 1), (2**60 + 1, "large", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, offset int")
    ids = defaultdict(list)
    for doc, text, _ in rows:
        ids[doc].append(library.encode(text or "", add_special_tokens=False).ids + [1])
    check(packing.pack_documents(frame, JSON, RANKS).collect(), ids, 2048)
    assert packing.pack_documents(frame.limit(0), JSON, RANKS).count() == 0


def test_best_fit_and_fullest():
    packer = packing.Packer(8, 2, iter(range(100)))
    ids = np.arange(100, dtype="<u4")
    packer.add(1, ids[:5])
    packer.add(2, ids[:3])  # fits the first best: emitted full
    packer.add(3, ids[:6])
    packer.add(4, ids[:5])
    packer.add(5, ids[:4])  # fits none: the fullest (3) takes two of it, two go on
    rows = [(r[0], r[1], r[2], r[5], r[6]) for r in packer.out]
    assert rows == [(1, 0, 5, 0, 0), (2, 0, 3, 0, 5), (3, 0, 6, 1, 0), (5, 0, 2, 1, 6)]
    packer.finish()
    assert [sum(n for _, _, n, s, _ in [(r[0], r[1], r[2], r[5], r[6]) for r in packer.out] if s == k) for k in (2, 3)] == [4, 2]
