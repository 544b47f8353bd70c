import hashlib
import random
import re

import pytest

from skylattice.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


@pytest.mark.parametrize("block", [200_000, 3])
def test_against_brute_force(spark, docs, texts, monkeypatch, block):
    monkeypatch.setattr(D, "WINDOW_BLOCK", block)
    monkeypatch.setattr(D, "SEGMENT_BYTES", 3000)
    items = [(1, texts[0][30:200]), (2, "one"), (3, texts[9]), (4, None), (5, "--"), (10, "one two"), (11, "ab ab ab ab ab ab ab ab ab ab ab"), (12, "é àé 漢字"), (13, texts[0][30:200]), (None, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.contamination(docs, bench).collect()
    assert len(got) == len(texts) + 2
    by = {r["doc_id"]: r for r in got}
    windows = {}
    for k, t in items:
        w = words_of(t)
        if w and k is not None:
            n = min(10, len(w))
            for i in range(len(w) - n + 1):
                windows.setdefault(tuple(w[i : i + n]), set()).add(k)
    for i, t in enumerate(texts):
        w, hit, found = words_of(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    found |= own
                    hit |= set(range(k, k + n))
        r = by[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), len(hit), len(found), bool(hit)), i
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()


def test_one_very_long_item_comes_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "WINDOW_BLOCK", 1000)
    words = [f"w{i * 7919 % 5003}" for i in range(7000)]
    blocks = list(D.windows(iter([(1, " ".join(words)), (2, "a b")])))
    assert max(len(b.item) for b in blocks) == 1000 and len(blocks) == 7
    monkeypatch.setattr(D, "WINDOW_BLOCK", 4000)
    docs = [(1, " ".join(words[995:1012])), (2, " ".join(words[5000:5015])), (3, "x " + " ".join(words[10:19])), (4, "a b")]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "a b")], "item_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in D.contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {1: (17, 1), 2: (15, 1), 3: (0, 0), 4: (2, 1)}


def test_proximity(spark):
    text = "alpha beta gamma delta eps zeta eta theta iota kappa"
    near = text.replace("delta", "delta new").replace("eta theta", "eta other")
    docs = spark.createDataFrame([(1, text), (2, near), (3, "nothing here")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in D.contamination(docs, spark.createDataFrame([(7, text)], "item_id long, text string")).collect()}
    assert out[1]["contaminated"] and not out[2]["contaminated"] and out[2]["near_items"] == [7] and out[3]["near_items"] == []


def near_by(window, words):
    """Whether some start has four fifths of the terms within SLOP words of their places."""
    least = -(-4 * len(window) // 5)
    for start in range(-len(window) - 2, len(words) + 3):
        places = (words[max(0, start + j - D.SLOP) : max(0, start + j + D.SLOP + 1)] for j in range(len(window)))
        if sum(t in p for t, p in zip(window, places, strict=True)) >= least:
            return True
    return False


@pytest.mark.parametrize(("segment", "tried"), [(8 << 20, 1 << 20), (400, 7)])
def test_proximity_against_brute_force(spark, monkeypatch, segment, tried):
    monkeypatch.setattr(D, "SEGMENT_BYTES", segment)
    monkeypatch.setattr(D, "TRIED", tried)
    r = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    items = [(i, r.sample(words, n)) for i, n in enumerate((10, 10, 11, 10, 4, 5, 6, 1, 2))]
    docs = []
    for i in range(90):
        own = list(r.choice(items)[1])
        for _ in range(r.randint(0, 4)):
            at = r.randrange(len(own))
            own[at : at + r.randint(0, 1)] = r.choices(words, k=r.randint(0, 2))
            own = own or ["w0"]
        docs.append((i, r.choices(words, k=r.choice((0, 0, 3))) + own + r.choices(words, k=r.choice((0, 0, 3)))))
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string").coalesce(1)
    got = {x["doc_id"]: x["near_items"] for x in D.contamination(frame, spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")).collect()}
    for i, own in docs:
        want = [k for k, w in items if any(near_by(w[at : at + 10], own) for at in range(max(1, len(w) - 9)))]
        assert got[i] == want, i


def test_near_match_without_the_rarest_term(spark):
    text = "alpha beta gamma delta eps zeta eta theta iota kappa"
    docs = [(1, text.replace("delta", "other")), (2, "delta"), *[(i, " ".join(w for w in text.split() if w != "delta")[i:]) for i in range(3, 6)]]
    out = {r["doc_id"]: r for r in D.contamination(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame([(7, text)], "item_id long, text string")).collect()}
    assert out[1]["near_items"] == [7] and out[2]["near_items"] == []


def test_empty(docs, empty, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contamination(docs, none).where("contaminated").count() == 0
    assert D.contamination(empty, none).count() == 0
    assert D.keep_clean(docs, none).count() == docs.count()
