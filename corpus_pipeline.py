"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)``, works on all that its predecessor kept and returns the
columns of ``documents``; the last returns the packed pieces.  ``run`` writes each stage's result to
the shared folder and reads it again for the next.

A null text stays null and counts as the empty text; empty texts are clean, and one of them is kept as
a near duplicate of the others.  A null id always stays until packing, where it is carried along.  Rows
that repeat an id stay or go together.  Of equal or near texts the least id stays, so there are no ties.
Very long texts are read whole.  Other columns are carried along under any name; an empty table gives
empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skylattice.llm import decontamination, packing, secrets, simhash, toxicity
from skylattice.llm.common import read_table, staged
from skylattice.llm.registry import tokenizer_path


def toxic_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"), toxicity.in_training())
    return toxicity.keep_clean(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the least id."""
    return simhash.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontamination.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; every document stays."""
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as token pieces placed in sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxic_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", benchmark_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: The stages rest on trained models and a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
