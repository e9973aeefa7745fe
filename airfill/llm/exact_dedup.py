"""Exact dedup (operator 7): a persistent index of text digests, bucketed and sorted by
digest. New data is reduced to one row per digest, anti-joined with the index by sort-merge
(the index side is already bucketed and sorted) and what is new is appended.

DataFrame functions only. Copies collapse before the shuffle; rows find their group again by
an equi-join from which digests of very many rows are taken out beforehand.

Defined results: null text counts as empty; of equal texts the row with the largest id stays
(null ids are smallest; of repeated ids one row); a text already in the index from an earlier
batch keeps no row of the new one; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airfill.llm.runtime import attach, identity, keyed, told_apart, verdicts
from airfill.session import scratch_path, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
INDEX_SCHEMA = "text_sha256 string, keep_id long, keep_row long, batch string"


def digest(text: Column) -> Column:
    """SHA-256, lowercase hex, of the text with A-Z lower-cased."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER).cast("binary"), 256)


class DigestIndex:
    """Digests seen so far, as a bucketed and sorted table at ``path`` (shared storage). Opening
    the same path again, also from another session, goes on with the same index."""

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = "digests_" + hashlib.md5(path.encode()).hexdigest()[:16]
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({INDEX_SCHEMA}) USING parquet "
                  f"CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {buckets} BUCKETS LOCATION '{path}'")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, digests: DataFrame) -> None:
        """Append digests that aren't in the index yet. Dealt by bucket first, so that a
        batch adds one file a bucket."""
        columns = [c.split()[0] for c in INDEX_SCHEMA.split(", ")]
        new = digests.join(self.table().select("text_sha256").hint("merge"), "text_sha256", "left_anti")
        (new.select(*columns).repartition(self.buckets, "text_sha256").sortWithinPartitions("text_sha256")
            .write.mode("append").format("parquet").option("path", self.path)
            .bucketBy(self.buckets, "text_sha256").sortBy("text_sha256").saveAsTable(self.name))


def dedup(docs: DataFrame, index: DigestIndex, batch: str = "0", id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """Add ``docs`` to the index as one batch. One row per document: doc_id, keep_id,
    group_size (rows of this text in the batch), kept, text_sha256."""
    rows = written(keyed(docs, id_col, text_col).select(
        "doc_id", F.monotonically_increasing_id().alias("row"), digest(F.col("text")).alias("text_sha256")),
        "dedup-digests")
    groups = written(rows.groupBy("text_sha256").agg(
        F.max(F.struct("doc_id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size")), "dedup-groups")
    index.append(groups.select("text_sha256", F.col("keep.doc_id").alias("keep_id"),
                               F.col("keep.row").alias("keep_row"), F.lit(batch).alias("batch")))
    known = groups.select("text_sha256", "group_size").join(index.table(), "text_sha256")
    found = attach(rows, known, "text_sha256", "group_size", rows.count())
    return found.select(
        "doc_id", "keep_id", "group_size",
        ((F.col("batch") == batch) & (F.col("row") == F.col("keep_row"))).alias("kept"), "text_sha256")


def fresh_index(spark: SparkSession) -> DigestIndex:
    """An empty index under the shared folder, with as many buckets as shuffle partitions."""
    return DigestIndex(spark, scratch_path(spark, "digest-index"), int(spark.conf.get("spark.sql.shuffle.partitions")))


def keep_one(docs: DataFrame, index: DigestIndex, batch: str = "0") -> DataFrame:
    """The rows of ``docs`` (read more than once) that stay, with all their columns: those new to the
    index, of equal texts the one with the largest doc_id. ``batch`` names this batch alone."""
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), identity().alias("key"),
                               digest(F.col("text")).alias("text_sha256")), "dedup-digests")
    groups = written(rows.groupBy("text_sha256").agg(F.max(F.struct("doc_id", "key")).alias("keep")), "dedup-groups")
    index.append(groups.select("text_sha256", F.col("keep.doc_id").alias("keep_id"), F.lit(-1).cast("long").alias("keep_row"),
                               F.lit(batch).alias("batch")))
    new = index.table().where(F.col("batch") == batch).select("text_sha256")
    stay = groups.join(new, "text_sha256", "left_semi").select("keep.key")
    return told_apart(docs, written(verdicts(rows, stay), "dedup-verdicts"))
