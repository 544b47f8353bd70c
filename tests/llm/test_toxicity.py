import os
import itertools
import random

import numpy as np
import pytest

from skylattice.llm import toxicity as T


def corpus(n=600, seed=2):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefgh", k=5)) for _ in range(300)]
    bad = ["vilest", "vilely", "grumpo", "grumpa", "Nasty"]
    texts, labels = [], []
    for i in range(n):
        w = r.choices(words, k=r.randint(5, 80))
        if i % 4 == 0:
            for _ in range(r.randint(1, 4)):
                w.insert(r.randrange(len(w)), r.choice(bad))
        texts.append(" ".join(w) + ".")
        labels.append(int(i % 4 == 0))
    return texts, labels


@pytest.fixture(scope="module")
def model():
    texts, labels = corpus()
    return T.fit([t.encode() for t in texts], labels)


def test_marginals_equal_enumeration(model):
    gaps, turn = model.gaps(), model.transition
    for position, score, n in (([1, 2, 5], [2.0, -1.0, 3.0], 8), ([0], [1.0], 1), ([3, 4], [0.5, 0.2], 6)):
        emit = np.full(n, model.bias)
        emit[position] = score
        weights = {}
        for y in itertools.product((0, 1), repeat=n):
            weights[y] = np.exp(sum(e for e, v in zip(emit, y, strict=True) if v) + sum(turn[a, b] for a, b in itertools.pairwise(y)))
        total = sum(weights.values())
        want = [sum(w for y, w in weights.items() if y[p]) / total for p in position]
        np.testing.assert_allclose(model.marginals(np.array(position), np.array(score), n, gaps), want, rtol=1e-9)


def test_held_out_accuracy(model):
    texts, labels = corpus(300, 9)
    raw, offsets = T._arrays([t.encode() for t in texts])
    scores = [model.score(p) for _, p in T._documents(model, raw, offsets)]
    assert np.mean([(s >= T.THRESHOLD) == bool(y) for s, y in zip(scores, labels, strict=True)]) > 0.97


def test_frame(spark, docs, empty, model):
    rows = {r["doc_id"]: r for r in T.score(docs, model).collect()}
    assert all(0 <= r["score"] <= 1 for r in rows.values()) and rows[3]["spans"] == [] and rows[3]["score"] == rows[4]["score"]
    one = spark.createDataFrame([(1, "É abcde Vilest ghabc"), (2, None)], "doc_id long, text string")
    span = T.score(one, model).where("doc_id = 1").first()["spans"]
    assert [(s["start"], s["end"]) for s in span] == [(8, 14)]
    assert T.score(empty, model).count() == 0
    kept = T.keep_clean(one, model)
    assert kept.columns == one.columns and [r["doc_id"] for r in kept.collect()] == [2]


def test_held_out_labels_are_not_used(spark, docs):
    labels = spark.createDataFrame([(i, 1 if i % 2 else None) for i in range(40)], "doc_id long, toxic int")
    out = T.toxicity(docs, labels)
    import zlib

    for r in out.collect():
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    none = labels.limit(0)
    assert T.toxicity(docs, none).where("score > 0.5").count() == 0


def test_ties_repeats_and_bounds_of_the_sample(spark, monkeypatch):
    texts, labels = corpus(120)
    rows = [(i, t, "x", 1.0) for i, t in enumerate(texts)] + [(0, texts[0], "y", 2.0)] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic string, score double").repartition(3)
    marks = spark.createDataFrame([(i, y) for i, y in enumerate(labels)] * 2, "doc_id long, toxic int")
    got, y = T.sample(df, marks)
    assert sorted(got) == sorted(t.encode() for t in texts) and sum(y) == sum(labels)
    monkeypatch.setattr(T, "MAX_BYTES", 1000)
    assert sum(len(t) for t in T.sample(df, marks)[0]) <= 1000
    model = T.fit([t.encode() for t in texts], labels)
    again = T.fit([t.encode() for t in texts], labels)
    assert (model.weight == again.weight).all()
    scores = T.score(df, model, spans=False).where("doc_id = 0").distinct().collect()
    assert len(scores) == 1


def test_long_words_are_read_whole():
    raw, offsets = T._arrays([b"abcdefgh" + b"x" * 50 + b"y", b"abcdefgh" + b"x" * 50 + b"z"])
    codes = T.tokens(raw, offsets)[2]
    assert codes[0][0] != codes[0][1] and codes[1][0] == codes[1][1] and not codes[-1].any() and not codes[-2].any()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="the given tables are absent")
def test_recall_on_the_held_out_third():
    import zlib

    import pyarrow.parquet as pq

    def third(i):
        return zlib.crc32(str(i).encode()) % 3

    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table("/root/testdata/sf0.1/labels.parquet").to_pylist() if r["toxic"] is not None}
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"]).to_pylist() if r["doc_id"] in labels}
    ids = sorted(texts)
    learned = [i for i in ids if third(i) != 1]
    model = T.fit([texts[i] for i in learned], [labels[i] for i in learned])
    asked = [i for i in ids if third(i) == 1]
    raw, offsets = T._arrays([texts[i] for i in asked])
    scores = [model.score(p) for _, p in T._documents(model, raw, offsets)]
    toxic = [s for i, s in zip(asked, scores) if labels[i]]
    clean = [s for i, s in zip(asked, scores) if not labels[i]]
    assert sum(s >= T.THRESHOLD for s in toxic) >= 0.9 * len(toxic) and sum(s >= T.THRESHOLD for s in clean) <= 0.01 * len(clean)


def test_null_id_is_held_out(spark, docs):
    labels = spark.createDataFrame([(0, 1), (5, 0), (None, 1)], "doc_id long, toxic int")
    rows = T.toxicity(docs, labels).where("doc_id is null").collect()
    assert rows and all(r["held_out"] for r in rows)
