"""Cross-tokenizer alignment against whole-text tokenisation and counting in dictionaries."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from skylattice.llm import alignment
from skylattice.llm.registry import SIDE_A, SIDE_B, tokenizer_path

A, B = tokenizer_path(SIDE_A), tokenizer_path(SIDE_B)
LETTERS = ["a", "b", "s", "t", "re", "ve", " ", "  ", "\n", "\t", "'", "!", "1", "é", "日", "本", " ", "😀", "<s>", "<0x41>", "<|endoftext|>", "\r\n", "▁", "　", "ﬁ", "\x00", "the", "ing"]


def brute(texts):
    """One row for each text: tokens of the whole text, groups, links, and counts over all texts."""
    side = alignment.Aligner.of(A, B)
    found, corpus = [], Counter()
    for text in texts:
        groups, a, b = [], [], []
        if text:
            whole = (" " + text).encode()
            a, b = side.a.encode(" " + text, add_special_tokens=False).ids, side.b.encode(text)
            if b"".join(side.a_bytes[i] for i in a) == whole == b"".join(side.b_bytes[i] for i in b):
                ends_a, ends_b = (np.cumsum([len(of[i]) for i in ids]).tolist() for of, ids in ((side.a_bytes, a), (side.b_bytes, b)))
                i = k = 0
                for cut in sorted(set(ends_a) & set(ends_b)):
                    j, m = ends_a.index(cut) + 1, ends_b.index(cut) + 1
                    groups.append((a[i:j], b[k:m]))
                    i, k = j, m
        links = Counter((x, y) for u, v in groups for x in u for y in v)
        corpus.update(links.keys())
        found.append((groups, len(a) if groups else 0, len(b) if groups else 0, links))
    best = defaultdict(int)
    for (x, _), n in corpus.items():
        best[x] = max(best[x], n)
    out = []
    for groups, n_a, n_b, links in found:
        text = ";".join(",".join(map(str, u)) + "|" + ",".join(map(str, v)) for u, v in groups)
        n_best = sum(n for p, n in links.items() if corpus[p] == best[p[0]])
        out.append((n_a, n_b, len(groups), sum(links.values()), n_best, sum(n * corpus[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


def rows_of(frame):
    return {r["doc_id"]: tuple(r)[1:] for r in frame.collect()}


def test_odd_texts_over_several_chunks(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 14))) for _ in range(1500)] + ["the end of the text"] * 300
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = rows_of(alignment.aligned(docs, A, B, chunk_bytes=2000))
    want = brute(texts)
    assert {i: got[i] for i in range(len(texts))} == dict(enumerate(want))


def test_odd_rows(spark):
    texts = [None, "", " ", "a" * 5000, "word " * 20000, "x▁y", "same", "same"]
    rows = [(i if i < 7 else None, t, "clash", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, chunk string, radix int")
    got = rows_of(alignment.aligned(docs, A, B))
    assert got == {i: w for (i, *_), w in zip(rows, brute(texts))}
    assert got[0] == got[1] == got[5] == (0, 0, 0, 0, 0, 0, "")
    assert alignment.aligned(docs.limit(0), A, B).count() == 0


def test_large_groups_are_counted_by_distinct_ids(monkeypatch):
    side = alignment.Aligner(A, B)
    units = [b" abcab", " 日本語の本".encode(), b" aaaaaaaaaaaaaaaaaaaaaaa!"]
    side._learn(units)
    monkeypatch.setattr(alignment, "LISTED_LINKS", 0)
    other = alignment.Aligner(A, B)
    other._learn(units)
    for u in range(len(units)):
        one, two = (Counter() for _ in range(2))
        for side_, count in ((side, one), (other, two)):
            index = np.array([u])
            for p, n in zip(side_.pairs.gather(index).tolist(), side_.times.gather(index).tolist()):
                count[p] += n
        assert one == two and sum(one.values()) == side.numbers[u][3]


def test_runs_merge_in_order_with_sums():
    runs = [alignment.packed_run(np.array(p), np.array(c)) for p, c in (([1, 5, 9], [1, 1, 2]), ([5, 7], [3, 1]), ([], []))]
    assert list(alignment.merged(runs)) == [(1, 1), (5, 4), (7, 1), (9, 2)]
    long = alignment.packed_run(np.arange(20000) * 3, np.ones(20000))
    assert list(alignment.merged([long, long])) == [(3 * i, 2) for i in range(20000)]


def test_the_query_on_the_tables(spark, sf_small):
    from skylattice.llm.common import read_table
    from skylattice.llm.registry import op13_tokenizer_alignment

    docs = [(r["doc_id"], r["text"]) for r in read_table(spark, sf_small, "documents").select("doc_id", "text").collect()]
    assert rows_of(op13_tokenizer_alignment(spark, sf_small)) == {i: w for (i, _), w in zip(docs, brute([t for _, t in docs]))}
