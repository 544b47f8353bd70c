import hashlib

import numpy as np
import pytest

from skylattice.llm import chunks, substrings


def reference(rows, length):
    seen = {}
    for i, b in rows:
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            seen[s] = min(seen.get(s, i), i)
    for i, b in rows:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] < i:
                gone[k : k + length] = True
        spans = int(np.diff(np.concatenate([[0], gone.astype(int)])).clip(0).sum())
        yield i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()


@pytest.mark.parametrize("size,block", [(1 << 20, 1 << 16), (500, 300)])
def test_against_brute_force(spark, docs, texts, monkeypatch, size, block):
    monkeypatch.setattr(substrings, "BLOCK", block)
    monkeypatch.setattr(chunks, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(substrings, "CHUNK_BYTES", size)
    more = [(500, "z" * 300), (501, "z" * 60), (502, texts[0][10:100] + "é" * 30), (503, "é" * 40), (504, (texts[0] or "")[5:] + texts[8][3:])]
    df = docs.where("doc_id is not null").select("doc_id", "text", "fp").unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in df.collect()]
    want = sorted(reference(rows, 50))
    got = sorted(tuple(r) for r in substrings.remove_repeats(df).collect())
    assert got == want


def test_longest_previous_factors_against_brute_force():
    rng = np.random.default_rng(3)
    for length in (3, 8, 13):
        parts = [bytes(rng.choice(list(b"ab"), rng.integers(length, 40)).astype(np.uint8)) for _ in range(25)]
        size = np.array([len(p) for p in parts])
        doc, run = rng.integers(0, 8, len(parts)), size - length + 1
        got = substrings.longest_previous_factors(np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, run, doc, length)
        suffixes = [(d, p[k : k + length]) for d, p in zip(doc.tolist(), parts, strict=True) for k in range(len(p) - length + 1)]

        def shared(x, y):
            return next((k for k in range(len(x)) if x[k] != y[k]), len(x))

        assert got.tolist() == [max((shared(s, t) for e, t in suffixes if e < d), default=0) for d, s in suffixes]


@pytest.mark.parametrize("counted,hot", [(1, 1), (2, 3)])
def test_hot_minimisers_are_split(spark, monkeypatch, counted, hot):
    monkeypatch.setattr(substrings, "COUNTED", counted)
    monkeypatch.setattr(substrings, "HOT_SEGMENTS", hot)
    rng = np.random.default_rng(1)
    line = "a passage that very many documents have in common, word for word"
    rows = [(i, "".join(rng.choice(list("abcdef "), rng.integers(0, 60))) + line[int(rng.integers(0, 8)) :] + "".join(rng.choice(list("abcdef "), rng.integers(0, 60)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(tuple(r) for r in substrings.remove_repeats(df).collect()) == sorted(reference([(i, t.encode()) for i, t in rows], 50))


def test_random_strings(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), "".join(rng.choice(list("ab"), rng.integers(0, 400)))) for i in rng.permutation(60)]
    rows += [(100 + i, rows[i][1][7:] + rows[i + 1][1]) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = sorted(reference([(i, t.encode()) for i, t in rows], 50))
    assert sorted(tuple(r) for r in substrings.remove_repeats(df).collect()) == want
    short = sorted(tuple(r) for r in substrings.remove_repeats(df, 12, 6).collect())
    assert short == sorted(reference([(i, t.encode()) for i, t in rows], 12))


def test_empty_and_null_id(spark, empty):
    assert substrings.remove_repeats(empty).count() == 0
    df = spark.createDataFrame([(None, "q" * 80), (1, "q" * 80)], "doc_id long, text string")
    out = {r["doc_id"]: r["n_removed"] for r in substrings.remove_repeats(df).collect()}
    assert out == {None: 80, 1: 0}
    kept = substrings.remove_repeats(df, texts=True).where("doc_id = 1").first()["kept"]
    assert kept == "q" * 80


def test_nearest_smaller_in_any_order():
    import time

    from skylattice.llm.substrings import _to_smaller

    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(1, 40))
        value, common = rng.integers(0, 6, n), rng.integers(0, 9, n)
        common[0] = 0
        want = []
        for i in range(n):
            least, j = common[i], i - 1
            while j >= 0 and value[j] >= value[i]:
                least, j = min(least, common[j]), j - 1
            want.append(least if j >= 0 else 0)
        assert _to_smaller(value, common).tolist() == want
    n = 100_000
    value, common = np.concatenate([np.arange(n) + 1, np.zeros(n, np.int64)]), np.full(2 * n, 50)
    common[0] = 0
    start = time.time()
    _to_smaller(value, common)
    assert time.time() - start < 2
