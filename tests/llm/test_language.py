import random

import numpy as np
from pyspark.sql import functions as F

from skylattice.llm import language as L

ALPHABETS = {"aa": "abcdeft", "bb": "klmnopt", "cc": "uvwxyzéé"}


def corpus(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lang = r.choice(sorted(ALPHABETS))
        text = " ".join("".join(r.choices(ALPHABETS[lang], k=r.randint(2, 8))) for _ in range(r.randint(3, 60)))
        out.append((i, text.replace(" ", "\n", 1), lang))
    return out


def test_held_out_accuracy_and_und(spark):
    rows = [*corpus(400, 1), (1000, None, "aa"), (1001, "12 34 !!", "aa"), (1002, "abc", None), (1003, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r["doc_id"]: r for r in L.identify(df).collect()}
    held = [r for i, r in got.items() if r["held_out"] and i < 1000]
    assert len(held) > 50
    assert np.mean([r["lang_pred"] == rows[r["doc_id"]][2] for r in held]) > 0.98
    for i in (1000, 1001, 1003):
        assert got[i]["lang_pred"] == "und" and got[i]["score"] == 0
    assert got[1002]["lang_pred"] == "aa"
    none = L.identify(df.where("lang is null"))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}
    assert L.identify(df.limit(0)).count() == 0


def test_grams_stay_within_rows():
    from skylattice.llm.common import text_buffer
    import pyarrow as pa

    whole, bound = L.grams(*text_buffer(pa.array(["ab cd", "", "Ab  cd"], pa.large_string())))
    assert whole[bound[0] : bound[1]].tolist() == whole[bound[2] : bound[3]].tolist() and bound[2] - bound[1] >= 0


def test_repeated_rows_clashing_columns_and_long_texts(spark):
    rows = [(i, t, lang, 7, 0.5, "x") for i, t, lang in corpus(300, 4)]
    rows += [rows[0]] * 40 + [(2000, "abcd " * 100_000, "aa", 1, 0.1, "y"), (None, "klmno klm", "bb", 1, 0.1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lettered int, score double, lang_pred string").repartition(4)
    got = L.identify(df).collect()
    assert len(got) == len(rows)
    assert len({(r["lang_pred"], r["score"]) for r in got if r["doc_id"] == 0}) == 1
    assert [r["lang_pred"] for r in got if r["doc_id"] == 2000] == ["aa"] and [r["lang_pred"] for r in got if r["doc_id"] is None] == ["bb"]


def test_a_rare_language_is_sampled(spark, monkeypatch):
    monkeypatch.setattr(L, "MAX_DOCUMENTS", 60)
    rows = [(i, "abc de", "aa") for i in range(500)] + [(1000 + i, "klm no", "bb") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    texts, languages = L.sample(df, F.lit(True))
    assert languages.count("bb") == 6 and languages.count("aa") == 54 and len(texts) == 60
    monkeypatch.setattr(L, "MAX_BYTES", 60)
    assert sum(len(t) for t in L.sample(df, F.lit(True))[0]) == 60
