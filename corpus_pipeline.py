"""The corpus pipeline: from ``documents`` to token ids, in stages that each apply one operator.

Every stage reads the table its predecessor wrote. All but the last return the columns they were
given; columns of these named as an operator's own results are carried past it untouched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rarespark.llm import bpe, decontam, jaccard, quality, substring
from rarespark.llm.common import materialize, table

ORACLE_SQL = None


def _apart(docs: DataFrame, apply: Callable[[DataFrame], DataFrame], *names: str) -> DataFrame:
    """Apply an operator to ``docs`` with clashing columns out of its way, and name them back."""
    clash = [c for c in docs.columns if c in names]
    away = {c: f"_carried_{c}" for c in clash}
    got = apply(docs.withColumnsRenamed(away))
    kept = [F.col(f"`{away.get(c, c)}`").alias(c) for c in docs.columns]
    return got.select(*kept)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps. Null, empty and wordless texts get no vote and
    are judged by the scorer's constant; repeated rows are judged alike, so all or none stay."""
    return _apart(docs, lambda d: quality.classify(d).where("keep"), "weak_posterior", "score", "keep")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of smallest id, of each class of near duplicates. Null and wordless texts
    are in no class and stay; of rows that share id and text one stays, rows without an id all stay."""
    return jaccard.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that passages repeated in what is left cover. A character that a
    cut would split goes whole. n_chars follows the text; null texts stay null, rows whose whole
    text goes stay with an empty one, rows that are equal lose all they share."""

    def cut(d: DataFrame) -> DataFrame:
        got = substring.remove_repeats(d)
        got = got.withColumn("text", F.when(F.size("removed") > 0, F.col("kept_text")).otherwise(F.col("text")))
        if "n_chars" in d.columns:
            got = got.withColumn("n_chars", F.when(F.size("removed") > 0, F.length("text").cast(d.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
        return got

    return _apart(docs, cut, "kept", "kept_text", "removed")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark. Null and wordless texts are not; an
    empty benchmark contaminates nothing; repeated rows stay or go together."""
    bench = table(spark, sf_dir, "benchmark")
    return _apart(docs, lambda d: decontam.find(d, bench).where(~F.col("contaminated")), "n_words", "n_hit", "items", "removed", "contaminated")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of each document, whose text the ids give back. Null
    and empty texts have no ids; each repeated row has its own; other columns end here."""
    got = bpe.encode(docs.select("doc_id", "lang", "source", "text"), bpe.default_path())
    return got.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", quality_filter),
    ("near_duplicate_join", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
