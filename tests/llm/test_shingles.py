import random

import numpy as np
import pyarrow as pa
import pytest

from skylattice.llm import shingles, simhash


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return a == b or (len(a | b) > 0 and 5 * len(a & b) >= 4 * len(a | b))


@pytest.fixture(scope="module")
def edited():
    """Copies with 0 to 4 words replaced, beside texts that share one line."""
    r = random.Random(8)
    words = ["".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(400)]
    line = r.choices(words, k=25)
    out = []
    for _ in range(12):
        base = r.choices(words, k=r.randint(60, 160))
        for edits in (0, 1, 1, 2, 3, 4):
            copy = list(base)
            for i in r.sample(range(len(copy)), edits):
                copy[i] = "changed" + str(r.randint(0, 9))
            out.append(" ".join(copy))
    out += [" ".join(line + r.choices(words, k=r.randint(5, 100))) for _ in range(20)] + [" ".join(line), "", " ", "one two", "One  two"]
    r.shuffle(out)
    return out


@pytest.mark.parametrize(("bucket", "hubs", "frequent"), [(32, 8, 4), (1, 1, 2), (4, 0, 10**9)])
def test_components_are_those_of_all_similar_pairs(spark, edited, monkeypatch, bucket, hubs, frequent):
    monkeypatch.setattr(shingles, "PAIRED_BUCKET", bucket)
    monkeypatch.setattr(shingles, "HUBS", hubs)
    monkeypatch.setattr(shingles, "FREQUENT", frequent)
    df = spark.createDataFrame(list(enumerate(edited)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in shingles.near_duplicates(df).collect()}
    sets = [grams(t) for t in edited]
    near = np.array([[alike(a, b) for b in sets] for a in sets])
    label = np.arange(len(sets))
    for _ in sets:
        label = np.array([label[n].min() for n in near])
    assert got == dict(enumerate(label.tolist()))


def test_stage_drops_an_edited_copy_that_two_bits_miss(spark, edited):
    r = random.Random(5)
    base = [f"w{r.randint(0, 500)}" for _ in range(100)]
    copy = base[:40] + ["edited"] + base[41:70] + ["other"] + base[71:]
    a, b = " ".join(base), " ".join(copy)
    assert bin(simhash.fingerprint(a.encode()) ^ simhash.fingerprint(b.encode())).count("1") > simhash.MAX_BITS
    df = spark.createDataFrame([(1, a), (2, b), (3, edited[0]), (None, a)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0) for r in simhash.keep_one(df).collect()) == [0, 1, 3]


def test_shingle_sets():
    sets = shingles.shingle_sets(pa.array(["a b c d e f", "A B C D  E", "b c d e f", "", "a b", "a b c d e a b c d e"]))
    assert [len(s) for s in sets] == [2, 1, 1, 0, 1, 5]
    assert set(sets[0].tolist()) == {int(sets[1][0]), int(sets[2][0])}


def test_far_copies_of_one_text_need_no_pair_of_each(spark, monkeypatch):
    """Copies with so many edits that half aren't similar to the base, and copies of those."""
    r = random.Random(4)
    words = ["".join(r.choices("abcdefghij", k=6)) for _ in range(2000)]
    base, texts = r.choices(words, k=150), []

    def copy_of(text, edits):
        out = list(text)
        for i in r.sample(range(len(out)), edits):
            out[i] = r.choice(words)
        return out

    for i in range(240):
        texts.append(copy_of(base, i % 9))
        if i % 40 == 8:
            texts.append(copy_of(texts[-1], 1))
    texts = [" ".join(t) for t in texts]
    asked, verified = [], shingles.verified
    monkeypatch.setattr(shingles, "verified", lambda pairs, *rest: (asked.append(pairs.count()), verified(pairs, *rest))[1])
    df = spark.createDataFrame(list(enumerate(texts)) * 2, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in shingles.near_duplicates(df).collect()}
    sets = [grams(t) for t in texts]
    near = np.array([[alike(a, b) for b in sets] for a in sets])
    label = np.arange(len(sets))
    for _ in range(20):
        label = np.array([label[n].min() for n in near])
    assert got == dict(enumerate(label.tolist())) and 40 < len(set(got.values())) < 200
    assert sum(asked) <= 8 * len(texts), asked


def test_hashes_are_counted_and_keys_meet_as_messages(monkeypatch):
    """Rows to the JVM are messages, not hashes; counts and shared keys are those of a direct count."""
    monkeypatch.setattr(shingles, "HELD", 500)
    monkeypatch.setattr(shingles, "FREQUENT", 3)
    r = random.Random(6)
    line = [f"w{r.randint(0, 999)}" for _ in range(40)]
    texts = ["", "one"] + [" ".join(line[: r.randint(5, 40)] + [f"w{r.randint(0, 999)}" for _ in range(60)]) for _ in range(60)]
    sets, buckets = shingles.shingle_sets(pa.array(texts)), 7

    def met(messages, bucket):
        rows = pa.Table.from_batches(messages)
        assert rows.num_rows <= buckets * len(messages) and len(messages) < len(texts)
        parts = [rows.filter(pa.array([b == k for b in rows.column("bucket").to_pylist()])) for k in range(buckets)]
        return pa.concat_tables([bucket(p) for p in parts]).to_pylist()

    batches = [pa.record_batch({"text": pa.array(texts[i : i + 9])}) for i in range(0, len(texts), 9)]
    got = met(list(shingles._count_batches(buckets)(iter(batches))), shingles._frequent_of)
    values, counts = np.unique(np.concatenate(sets), return_counts=True)
    low = values < np.uint64(int(shingles.COUNTED_SHARE * (1 << 64)))
    want = {(int(v.view(np.int64)), int(c)) for v, c in zip(values[low], counts[low], strict=True) if c >= 3}
    assert {(g["h"], g["count"]) for g in got} == want and len(got) == len(want) > 5

    prefixes = [s[: shingles.prefix_length(len(s))] for s in sets]
    # The third text stands twice, as a repeated row.
    rows = [(m, len(sets[m]), prefixes[m].tobytes()) for m in [*range(len(sets)), 2]]
    batches = [pa.record_batch({"mark": pa.array([x[0] for x in part], pa.int64()), "size": pa.array([x[1] for x in part], pa.int32()), "prefix": pa.array([x[2] for x in part], pa.binary())}) for part in (rows[:30], rows[30:])]
    got = met(list(shingles._key_batches(buckets)(iter(batches))), shingles._shared_of)
    values, counts = np.unique(np.concatenate(prefixes), return_counts=True)
    n = dict(zip(values.tolist(), counts.tolist(), strict=True))
    want = {(int(k.view(np.int64)), m, len(sets[m]), place, n[int(k)]) for m, own in enumerate(prefixes) for place, k in enumerate(own) if n[int(k)] > 1}
    assert {tuple(g.values()) for g in got} == want and len(got) == len(want) > 20


def test_workers_remember_no_large_table():
    golay = simhash.Golay.shared()
    assert sum(a.nbytes for a in vars(golay).values()) < 1 << 20


def test_messages_shrink_to_the_hashes():
    h = np.sort(np.random.default_rng(3).integers(0, 2**62, 4000, dtype=np.uint64))
    sent = shingles._sent(shingles._counts(h, np.ones(len(h), np.int64)), "h", 1).column("data")
    assert pa.compress(sent[0].as_py(), codec="lz4", asbytes=True).__len__() <= 8.2 * len(h)
    assert (shingles._read(pa.chunked_array([sent]), shingles.COUNT)["h"] == h).all()


def test_bitmaps_bound_what_two_sets_share():
    r = np.random.default_rng(5)
    empty = np.zeros(0, np.uint64)
    for n in (1, 3, 40, 700):
        for m in (0, n // 3, n, 5 * n):
            for common in (0, min(n, m) // 2, min(n, m)):
                h = np.unique(r.integers(0, 2**63, n + m + 9, dtype=np.uint64))[: n + m - common]
                r.shuffle(h)
                x, y = h[:n], h[n - common :]
                bound = shingles.can_share(len(x), shingles.sketch(x), len(y), shingles.sketch(y))
                assert common <= bound <= min(n, m)
    assert shingles.can_share(0, shingles.sketch(empty), 0, shingles.sketch(empty)) == 0
    x, y = r.integers(0, 2**63, (2, 1000), dtype=np.uint64)
    # Unlike sets stay far below what similar ones of this size must share.
    assert 3 * shingles.can_share(1000, shingles.sketch(x), 1000, shingles.sketch(y)) < 2 * 1000
    assert len(shingles.sketch(x)) <= len(x) // 2


def test_whole_sets_are_made_only_for_pairs_that_can_be_similar(spark, monkeypatch):
    """Texts that share a passage meet in buckets, but their bitmaps tell them apart."""
    r = random.Random(3)
    words = ["".join(r.choices("abcdefghij", k=6)) for _ in range(3000)]
    line = r.choices(words, k=40)
    # Fewer than make a hash frequent, so that the passage is among the keys.
    texts = [" ".join(line + r.choices(words, k=260)) for _ in range(shingles.FREQUENT - 3)]
    last = len(texts)
    texts.append(texts[7] + " edited")
    asked, sets_of = [], shingles.sets_of
    monkeypatch.setattr(shingles, "sets_of", lambda marks, *rest: (asked.extend(r["mark"] for r in marks.distinct().collect()), sets_of(marks, *rest))[1])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in shingles.near_duplicates(df).collect()}
    assert got == {i: 7 if i == last else i for i in range(last + 1)}
    assert 2 <= len(asked) <= 6, len(asked)
