"""Table sinks: keyed upsert and resume (SK1, SK2, U2).

A Parquet table has no MERGE, so the upsert rewrites only the partitions the new rows
touch: old rows of those partitions + new rows -> latest row per key -> a staged copy
-> dynamic partition overwrite. Staging is needed because Spark cannot overwrite a
path it is reading. Callers pass paths on storage that all executors share.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airfill.operators.readings import dedupe_latest


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


#: Rows a written file holds at most; a partition with more is split over files and tasks.
FILE_ROWS = 1_000_000


def upsert(df: DataFrame, path: str, keys: Sequence[str], order: Sequence[Column],
           partition_col: str, staging_root: str | None = None, file_rows: int = FILE_ROWS) -> None:
    """SK1: keyed upsert of ``df`` into the Parquet table at ``path`` partitioned by
    ``partition_col``; per key the row with the greatest ``order`` wins (ties: new
    rows, which carry a higher write sequence).

    A key has to keep its partition (a partition column derived from the keys does); a key
    that arrives for another partition than it is stored in raises ``ValueError`` and changes
    nothing. The stored partitions the new rows touch are named in the read, so that only
    those are scanned; a partition is written by as many tasks as its rows need. The copy is
    staged and then swapped in partition by partition, which is not atomic over partitions: a
    failed swap is repaired by running the same upsert again."""
    spark = df.sparkSession
    stage = f"{staging_root or path.rstrip('/') + '_staging'}/{uuid.uuid4().hex}"
    df.write.parquet(f"{stage}/new")  # read several times below
    new = spark.read.schema(df.schema).parquet(f"{stage}/new").withColumn("_seq", F.lit(1))
    sizes = {r[0]: r[1] for r in new.groupBy(partition_col).count().collect()}  # one row a partition
    if not sizes:
        _remove(spark, stage)
        return
    if _exists(spark, path):
        stored = spark.read.schema(df.schema).parquet(path)
        moved = (stored.select(*keys, F.col(partition_col).alias("_was"))
                       .join(new.select(*keys, partition_col).distinct(), list(keys))
                       .where(~F.col("_was").eqNullSafe(F.col(partition_col)))) if partition_col not in keys else None
        if moved is not None and not moved.isEmpty():
            _remove(spark, stage)
            raise ValueError(f"a key is stored under another {partition_col}")
        named = F.col(partition_col).isin([v for v in sizes if v is not None])
        touched = named | F.col(partition_col).isNull() if None in sizes else named
        old = stored.where(touched).withColumn("_seq", F.lit(0)).select(*new.columns)
        sizes |= {r[0]: r[1] + sizes[r[0]] for r in old.groupBy(partition_col).count().collect()}
        new = old.unionByName(new)
    merged = dedupe_latest(new, keys, [*order, F.col("_seq")]).drop("_seq")
    # rows of a large partition are dealt over several files by key
    parts = F.lit(1)
    for value, n in sizes.items():
        if n > file_rows:
            parts = F.when(F.col(partition_col).eqNullSafe(F.lit(value)), -(-n // file_rows)).otherwise(parts)
    dealt = merged.withColumn("_part", F.pmod(F.xxhash64(*keys), parts))
    (dealt.repartition(max(1, sum(-(-n // file_rows) for n in sizes.values())), partition_col, "_part").drop("_part")
          .write.partitionBy(partition_col).parquet(f"{stage}/merged"))
    (spark.read.schema(df.schema).parquet(f"{stage}/merged").write.mode("overwrite")
          .option("partitionOverwriteMode", "dynamic").partitionBy(partition_col).parquet(path))
    _remove(spark, stage)


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a staged copy this module wrote."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def only_new(df: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SK2 / J5 / U2: rows whose key is not stored yet (resume)."""
    return df.join(stored.select(*keys).distinct(), list(keys), "left_anti")


def bucketed(df: DataFrame, name: str, path: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """``df`` stored at ``path`` as a table bucketed and sorted by ``keys``: tables stored alike are joined on all
    the keys without another shuffle or sort. Dealt by bucket first, so that a bucket is one file."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex[:12]}"
    (df.repartition(buckets, *keys).sortWithinPartitions(*keys).write.format("parquet").option("path", path)
       .bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table))
    return spark.table(table)
