import os
import re

import pytest

import corpus_pipeline
from skylattice.llm import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are absent")


def test_stages_keep_columns_and_shrink(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        m = out.count()
        assert m == n if name == "secrets" else 0 < m <= n
        docs, n = out, m
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == n


ODD = "hits, hex, assign, access, spans, gone, gone_, base, markov, items, segment, row, score, mark, fp"


def test_odd_rows_pass_every_stage(spark, docs, empty, texts, tmp_path):
    """Nulls, blanks, copies, repeated rows, clashing columns and empty tables: every stage against a direct rule."""
    folder = str(tmp_path)
    item = " ".join(texts[13].split()[:12]) if len(texts[13].split()) >= 12 else "no such words in any text here at all ten"
    spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    names = [n for n in ODD.split(", ") if n not in docs.columns]
    wide = docs.selectExpr("*", *[f"'x' AS {n}" for n in names])
    rows = {name: stage(spark, wide, folder) for name, stage in corpus_pipeline.STAGES}
    before = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]is None, r["text"] or "") for r in wide.select("doc_id", "text").collect())
    for name in ("toxicity", "secrets"):
        assert rows[name].columns == wide.columns
        after = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] is None, r["text"] or "") for r in rows[name].select("doc_id", "text").collect())
        assert after == before, name
    kept = [r["doc_id"] for r in rows["near_duplicates"].select("doc_id").collect()]
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(" ".join((t or "").lower().split()), i)
    exact = {i for i, t in enumerate(texts) if first[" ".join((t or "").lower().split())] == i}
    assert None in kept and {k for k in kept if k is not None} <= exact and 0 in kept and 1 not in kept and kept.count(0) == 2
    words = [" ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())) for t in texts]
    window = " ".join(re.findall(r"\w+", item.lower())[:10])
    clean = {i for i, w in enumerate(words) if f" {window} " not in f" {w} " and not any(f" {' '.join(item.lower().replace('.', '').split()[k : k + 10])} " in f" {w} " for k in range(3))}
    assert {r["doc_id"] for r in rows["decontamination"].select("doc_id").collect()} - {None} == clean
    assert rows["packing"].where("doc_id = 3").count() == 1
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0


def test_toxic_documents_go_and_clean_ones_stay(spark, tmp_path):
    import random

    r = random.Random(2)
    words = ["".join(r.choices("abcdefgh", k=5)) for _ in range(300)]
    bad = ["vilest", "vilely", "grumpo", "grumpa", "nasty"]
    rows = []
    for i in range(600):
        own = r.choices(words, k=r.randint(5, 80))
        for _ in range(r.randint(1, 4) if i % 4 == 0 else 0):
            own.insert(r.randrange(len(own)), r.choice(bad))
        rows.append((i, " ".join(own), "en", "s", 1))
    folder = str(tmp_path)
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    kept = {r["doc_id"] for r in corpus_pipeline.toxic_stage(spark, docs, folder).collect()}
    toxic, clean = {i for i in range(600) if i % 4 == 0}, {i for i in range(600) if i % 4}
    assert len(kept & toxic) <= 0.1 * len(toxic) and len(kept & clean) >= 0.99 * len(clean)


def test_registry():
    names = list(registry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(registry.oracle_sql()) <= set(names)
