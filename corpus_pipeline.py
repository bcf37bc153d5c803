"""Corpus pipeline: language ID, near-duplicates, personal data, mixing, tokens. Each stage reads what the one before wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import byte_bpe, language, mixing, pii, simhash
from termloom.llm.common import stage_table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay, as they are: those without letters (und) go, as do unclear predictions."""
    return language.with_known_language(docs, language.fit(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: the one with the smallest id."""
    return simhash.one_of_each(docs)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span found is replaced in the text; n_chars follows."""
    model = pii.fit()
    clean = pii.redact(docs, model)
    length = F.coalesce(F.length("text"), F.lit(0)).cast(dict(docs.dtypes).get("n_chars", "bigint"))
    return clean.withColumn("n_chars", length) if "n_chars" in docs.columns else clean


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeat, or go, as the mix of sources takes them."""
    return mixing.mixed_rows(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, offsets of every row."""
    return byte_bpe.encode(docs, byte_bpe.ranks_file())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("pii", personal_data_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", token_stage),
]

#: Fingerprints, the classifier and the merges have no SQL form; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
