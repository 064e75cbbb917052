"""The queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import divergence, merkle, minhash, quality, toxicity
from ._shared import table
from .decontamination import ORACLE as DECONTAMINATION
from .decontamination import contamination, digest
from .language import identified
from .packing import pack
from .pii import personal_data
from .quality_rules import ORACLE as QUALITY_RULES
from .quality_rules import filtered
from .simhash import near_duplicates
from .suffix import deduplicated
from .tokens import token_counts


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), capacity=4096, end_id=1, remembered=250_000)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"), length=100)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), sample=1500, neighbours=15)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), sample=4000)


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(table(spark, sf_dir, "documents"), least_rows=200, spread=4)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), limit=2048)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=2)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return merkle.audited(docs, merkle.tampered(docs))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audited(table(spark, sf_dir, "documents"), least_docs=30, top=50)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_toxicity": op5_toxicity,
        "op6_benchmark_decontamination": op6_benchmark_decontamination,
        "op7_quality_rules": op7_quality_rules,
        "op8_token_counts": op8_token_counts,
        "op9_simhash": op9_simhash,
        "op10_pii": op10_pii,
        "op11_minhash": op11_minhash,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_source_divergence": op13_source_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_benchmark_decontamination": DECONTAMINATION, "op7_quality_rules": QUALITY_RULES, "op12_merkle_manifest": merkle.ORACLE, "op13_source_divergence": divergence.ORACLE}
