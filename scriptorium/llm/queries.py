"""The package's queries: one for each operator, and the pipeline.

``queries()`` and ``oracle_sql()`` have the shape that ``__spark_entry__``
gives to all queries of the library.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm import common, decontam, licenses, oracles, packing, pii, simhash, substring, suffix, tokens, topk, toxicity

#: Vocabulary files, by the paths that the installed package gives.
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.counts(common.table(spark, sf_dir, "documents"), PIECES)


def op2_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(common.table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(common.table(spark, sf_dir, "documents"), WORD_BPE)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op6_cover_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(common.table(spark, sf_dir, "embeddings"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_bytes(common.table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(common.table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_words(common.table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(common.table(spark, sf_dir, "documents"))


QUERIES: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    op1_token_counts,
    op2_pii_pseudonyms,
    op3_best_fit_packing,
    op4_toxicity,
    op5_decontamination,
    op6_cover_tree_search,
    op7_suffix_dedup,
    op8_simhash,
    op9_substring_dedup,
    op10_license_scan,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
