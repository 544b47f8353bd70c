"""Byte-level BPE against the tiktoken library."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken

import public_tokenizers
from skylattice.llm import bpe
from skylattice.llm.common import text_buffer
from skylattice.llm.pieces import piece_starts
from skylattice.llm.registry import RANKS, tokenizer_path

PATH = tokenizer_path(RANKS)
LETTERS = ["a", "b", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", "'", "'s", "!", "1", "²", "é", "日", " ", " ", "😀", "_", "\r\n", "Ᲊ", "<|endoftext|>"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def ids_of(texts):
    raw, offsets = text_buffer(pa.array(texts))
    ids, bounds = bpe.Merges.of(PATH).encode(raw, offsets)
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]


def test_odd_texts_as_the_library(library):
    rng = random.Random(4)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 16))) for _ in range(4000)]
    assert ids_of(texts) == [library.encode_ordinary(t) for t in texts]


def test_long_words_as_the_library(library):
    rng = random.Random(5)
    texts = ["a" * 20000, "ab" * 3000, "the" * 3000, "日本語" * 700, "".join(rng.choice("abcdefgh") for _ in range(4000)), "x" * 64, "x" * 65]
    assert ids_of(texts) == [library.encode_ordinary(t) for t in texts]


def test_words_on_both_sides_of_the_long_bound_agree(library, monkeypatch):
    rng = random.Random(6)
    words = [bytes(rng.choice(b"abeiou nrst") for _ in range(rng.randint(2, 40))) for _ in range(500)]
    merges = bpe.Merges.of(PATH)
    short = [x.tolist() for x in merges.contracted(words)]
    monkeypatch.setattr(bpe, "LONG_WORD", 1)
    monkeypatch.setattr(bpe, "HELD_ROWS", 20_000)
    assert [x.tolist() for x in merges.contracted(words)] == short


def test_pieces_at_text_bounds():
    raw, offsets = text_buffer(pa.array(["a ", " b", "'s", "", "'", "s"]))
    assert np.flatnonzero(piece_starts(raw, offsets)).tolist() == [0, 1, 2, 4, 6, 7]


def test_forgetting_does_not_change_ids(library, monkeypatch):
    merges = bpe.Merges(PATH)
    merges.known.most = 3
    texts = ["one two three four five six", "six five four", "one two"]
    for t in texts * 2:
        raw, offsets = text_buffer(pa.array([t]))
        assert merges.encode(raw, offsets)[0].tolist() == library.encode_ordinary(t)


def test_unknown_id_is_an_error():
    with pytest.raises(ValueError):
        bpe.Merges.of(PATH).decode([np.array([60000], np.uint32)])


def test_round_trip_of_odd_rows(spark, library):
    texts = [None, "", "Hello, world's end", "Hello, world's end", "word " * 30000, "\n\n x"]
    rows = [(i if i != 5 else None, t, "clash", "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, data string")
    got = {r["doc_id"]: r for r in bpe.round_trip(docs, PATH).collect()}
    assert len(got) == len(texts)
    for i, t, *_ in rows:
        t = t or ""
        ids = np.array(library.encode_ordinary(t), "<u4")
        assert tuple(got[i][1:]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0
    both = {r["doc_id"]: bytes(r["data"]).decode() for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect()}
    assert both == {i: t or "" for i, t, *_ in rows}


def test_the_query_on_the_tables(spark, sf_small, library):
    from skylattice.llm.common import read_table
    from skylattice.llm.registry import op11_byte_bpe

    texts = {r["doc_id"]: r["text"] or "" for r in read_table(spark, sf_small, "documents").select("doc_id", "text").collect()}
    got = op11_byte_bpe(spark, sf_small).collect()
    assert {r["doc_id"] for r in got} == set(texts)
    for r in got:
        ids = np.array(library.encode_ordinary(texts[r["doc_id"]]), "<u4")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())
