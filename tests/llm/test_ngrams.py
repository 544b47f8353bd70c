import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from skylattice.llm import chunks, ngrams


def reference(rows):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    tokens = [(i, re.findall(r"[^\x20\x09-\x0D]+", low(t)) + [None]) for i, t in rows]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    c, pairs = Counter(), Counter()
    for i, t in tokens:
        if not held(i):
            c.update(t)
            pairs.update(zip([0, *t[:-1]], t, strict=True))
    n, v = sum(c.values()), len(c)
    count = lambda x: np.array([sum(k == j for k in x.values()) for j in (1, 2, 3, 4)])
    cont = Counter(b for _, b in pairs)
    d2, d1 = [0, *ngrams.discounts(count(pairs))], [0, *ngrams.discounts(count(cont))]
    s = sum(cont.values())
    spread = sum(d1[min(k, 3)] for k in cont.values()) / s
    total, left = Counter(), defaultdict(float)
    for (a, _), k in pairs.items():
        total[a] += k
        left[a] += d2[min(k, 3)]

    def below(b):
        return max(cont[b] - d1[min(cont[b], 3)], 0) / s + spread / (v + 1)

    for i, t in tokens:
        score, before = 0.0, 0
        for b in t:
            k = pairs[before, b]
            score += math.log10((max(k - d2[min(k, 3)], 0) + left[before] * below(b)) / total[before] if total[before] else below(b))
            before = b
        yield i, held(i), len(t), sum(c[b] > 0 for b in t), n, sum(math.log10((c[b] + 0.1) / (n + 0.1 * (v + 1))) for b in t), score


NAMES = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@pytest.mark.parametrize(("size", "followers"), [(1 << 20, 200), (600, 200), (600, 2)])
def test_scores(spark, docs, monkeypatch, size, followers):
    monkeypatch.setattr(ngrams, "CHUNK_BYTES", size)
    monkeypatch.setattr(ngrams, "HOT_FOLLOWERS", followers)
    monkeypatch.setattr(chunks, "BUCKET_BYTES", 2000)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    key = lambda r: (r[0] is None, r[0] or 0)
    want = sorted(reference(rows), key=key)
    model, scored = ngrams.learn_and_score(docs)
    assert bool(len(model.hot.words)) == (followers == 2)
    got = sorted((tuple(r[n] for n in NAMES) for r in scored.collect()), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_stored_model_scores_other_texts(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(chunks, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(ngrams, "HOT_FOLLOWERS", 5)
    model, scored = ngrams.learn_and_score(docs)
    before = {r["doc_id"]: r["score"] for r in scored.collect()}
    new = spark.createDataFrame([(i, texts[i]) for i in (0, 2, 8)] + [(900, "words that no text has"), (901, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in model.score(new).collect()}
    for i in (0, 2, 8):
        assert got[i]["score"] == pytest.approx(before[i], rel=1e-12)
    assert got[900]["n_tokens"] == 6 and got[900]["score"] < 0 and got[901]["n_tokens"] == 1
    again = {r["doc_id"]: r["score"] for r in model.score(new.where("doc_id < 900")).collect()}
    assert again == {i: got[i]["score"] for i in (0, 2, 8)}


def test_packed_numbers_come_back():
    key = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2))
    small = np.arange(7, dtype=np.uint16)
    a, b, c = ngrams._unwrap(ngrams._wrap(key, small, key[:0]), np.uint64, np.uint16, np.uint64)
    assert (a == key).all() and (b == small).all() and len(c) == 0


def test_probabilities_add_up():
    d = ngrams.discounts(np.array([100, 40, 20, 10]))
    assert 0 < d[0] < 1 and d[1] < 2 and d[2] < 3


def test_empty(empty, spark):
    assert ngrams.score(empty).count() == 0
    only = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    assert ngrams.score(only).first()["score"] == 0.0
