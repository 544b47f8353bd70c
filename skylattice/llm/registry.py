"""Queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, bpe, decontamination, html_extract, language, ngrams, orchard, packing, quality, secrets, simhash, substrings, toxicity
from .common import read_table

#: Vocabulary files of the queries, of the installed public tokenizers: packing, encoding, and the two aligned sides.
TOKENIZER, RANKS, SIDE_A, SIDE_B = "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read_table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read_table(spark, sf_dir, "documents"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read_table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.score(read_table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(read_table(spark, sf_dir, "documents"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read_table(spark, sf_dir, "documents"), tokenizer_path(RANKS))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orchard.clusters(read_table(spark, sf_dir, "embeddings"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(read_table(spark, sf_dir, "documents"), tokenizer_path(SIDE_A), tokenizer_path(SIDE_B))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash_near_dedup": op1_simhash_near_dedup,
        "op2_html_extraction": op2_html_extraction,
        "op3_toxicity": op3_toxicity,
        "op4_secret_scans": op4_secret_scans,
        "op5_quality_rules": op5_quality_rules,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op7_decontamination": op7_decontamination,
        "op8_language_id": op8_language_id,
        "op9_lm_scoring": op9_lm_scoring,
        "op10_suffix_dedup": op10_suffix_dedup,
        "op11_byte_bpe": op11_byte_bpe,
        "op12_centroid_clustering": op12_centroid_clustering,
        "op13_tokenizer_alignment": op13_tokenizer_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_quality_rules": quality.ORACLE, "op12_centroid_clustering": orchard.ORACLE}
