import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from skylattice.llm import simhash


def direct(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lower) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_components(docs, texts):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(texts) + 2
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    for i, t in enumerate(texts):
        assert by[i]["fingerprint"] == f"{direct(t):016x}"
    f = np.array([direct(t) for t in texts], np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None]) <= 2
    label = np.arange(len(texts))
    for _ in range(len(texts)):
        label = np.array([label[near[i]].min() for i in range(len(texts))])
    assert [by[i]["component_id"] for i in range(len(texts))] == label.tolist()


def test_jvm_hash_is_the_same(spark):
    got = spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0]
    assert got % 2**64 == xxhash.xxh64_intdigest(b"a b c", seed=42)


def test_keys_never_miss_two_bits():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, rng.integers(0, 3), replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    keys = []
    for v in (x, y):
        row, key = simhash.fuzzy_keys(v.view(np.int64))
        own = [set() for _ in v]
        for r, k in zip(row.tolist(), key.tolist(), strict=True):
            own[r].add(k)
        keys.append(own)
    assert all(a & b for a, b in zip(*keys, strict=True))


@pytest.mark.parametrize("limit", [1, 32])
def test_large_buckets_give_the_same_components(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "PAIRED_BUCKET", limit)
    base = 0x0123456789ABCDEF
    fps = sorted({base ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12)} | {base ^ 0xFFFF, 5})
    df = spark.createDataFrame([(v,) for v in fps], "fp long")
    edges = {tuple(sorted(r)) for r in simhash.links(df).collect()}
    assert all(bin(a ^ b).count("1") <= 2 for a, b in edges)
    root = {v: v for v in fps}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert len({find(v) for v in fps}) == 3


def test_keep_one_and_empty(docs, empty, texts):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert 1 not in ids and ids.count(0) == 2 and None in ids and 3 in ids and 4 not in ids
    assert simhash.near_duplicates(empty).count() == 0


def test_keep_one_verifies_the_pairs_of_the_fingerprints(docs, texts, monkeypatch):
    seen, near_duplicates = [], simhash.shingles.near_duplicates

    def watched(table, candidates=None):
        seen.extend((r["x"], r["y"]) for r in candidates.collect())
        return near_duplicates(table, candidates)

    monkeypatch.setattr(simhash.shingles, "near_duplicates", watched)
    kept = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    f = np.array([direct(t) for t in texts], np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None]) <= 2
    joined = np.eye(len(texts), dtype=bool)
    for x, y in seen:
        joined[x, y] = joined[y, x] = True
    for links in (near, joined):
        for _ in range(6):
            links |= links @ links
    assert (near == joined).all() and near.sum() > len(texts)
    assert 0 in kept and 1 not in kept
