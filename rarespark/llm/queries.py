"""The operators' queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rarespark.llm import ann, bpe, decontam, jaccard, langid, lm, quality, sharding, sql, substring, toxicity
from rarespark.llm.common import table


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.op1(table(spark, sf_dir, "documents"))


def op2_toxicity_bigru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op2(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.op3(table(spark, sf_dir, "embeddings"))


def op4_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op4(table(spark, sf_dir, "documents"))


def op5_suffix_radix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.op5(table(spark, sf_dir, "documents"))


def op6_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.op6(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), bpe.default_path())


def op8_bayesian_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.op8(table(spark, sf_dir, "documents"))


def op9_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op9(table(spark, sf_dir, "documents"))


def op10_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op10(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_kneser_ney, op2_toxicity_bigru, op3_learned_partitions, op4_histogram_sharding, op5_suffix_radix_dedup, op6_fm_index_decontamination, op7_byte_bpe, op8_bayesian_jaccard_join, op9_hyperdimensional_language, op10_weak_label_quality)}


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
