"""The corpus pipeline: documents through quality rules, exact dedup, SimHash near-dedup, PII
and packing, each stage one of the numbered operators over all that its predecessor kept.

Defined results, besides those that the operators state: extra columns of documents, whatever their
names, are kept unchanged by every stage but the last; an empty table gives an empty result; a row
without an id is a row like any other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from airfill.llm import exact_dedup, fertility, packing, pii, simhash
from airfill.session import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that the base rules or the fertility bands reject go. A null or empty text
    has under 20 words and goes; repeated rows and ids are judged each."""
    return fertility.filtered(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of equal texts the document with the largest doc_id stays, one row of it where rows
    repeat; a row without an id stays only where no equal text has one."""
    return exact_dedup.keep_one(docs, exact_dedup.fresh_index(spark))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of each near-duplicate group the document with the smallest doc_id stays, one row of
    it where rows repeat; texts without a word are one group."""
    return simhash.keep_one(docs, shingle=4, distance=4)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: personal data in texts is replaced by its kind; n_chars follows. Every row stays, null
    text stays null."""
    return pii.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: every document's tokens in sequences; the pipeline's result. A null or empty text is
    its end id alone; repeated ids are documents of their own."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("exact dedup", exact),
    ("simhash near-dedup", near),
    ("pii", private),
    ("packing", pack),
]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
