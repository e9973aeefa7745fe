"""What the text operators share: inputs, Arrow batches, the package on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python task works on at a time (one longer text is its own slice).
SLICE_BYTES = 2 << 20
#: Digests of 16 bytes that are broadcast at most (under 100 MB as a hash table).
BROADCAST_KEYS = 1_000_000
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors once a session, so that their Python workers can
    import it whether or not the cluster has it installed."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="airfill-package-"), "airfill_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns the operators read, under fixed names; whatever else ``docs`` holds
    (also columns named like an operator's results) is left behind. Null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def unused(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``docs`` starts with it: for helper columns."""
    while any(c.lower().startswith(name.lower()) for c in docs.columns):
        name = "_" + name
    return name


def identity(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A digest of a row's id and whole text, the same whenever the row is read: verdicts on rows can
    be carried by it, without their texts. Null text counts as empty."""
    own = F.col(id_col).cast("string")
    return F.unhex(F.md5(F.concat(F.coalesce(F.concat(F.length(own).cast("string"), F.lit(":"), own), F.lit("-:")),
                                  F.coalesce(F.col(text_col).cast("string"), F.lit(""))).cast("binary")))


def verdicts(rows: DataFrame, stay: DataFrame) -> DataFrame:
    """(key, stays) of the identities in ``rows`` that not every row of keeps: those not in ``stay``, and
    those that stay but are carried by several rows, of which one stays."""
    return (rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
                .join(stay.select("key", F.lit(True).alias("stays")), "key", "left")
                .where(F.col("stays").isNull() | (F.col("n") > 1)).select("key", F.col("stays").isNotNull().alias("stays")))


def _met(keys: DataFrame) -> DataFrame:
    """A written table of digests marked for broadcast up to ``BROADCAST_KEYS`` rows, else for a join by sort
    and merge."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys.hint("merge")


def told_apart(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """``docs`` after ``marks`` (a written table of ``verdicts``): rows without a mark stay, and one row of
    each identity marked as staying. Texts are not written, and only shuffled beyond ``BROADCAST_KEYS`` marks."""
    own = unused(docs, "_identity")
    rows, keys = docs.withColumn(own, identity()), F.col("key").alias(own)
    repeated = (rows.join(_met(marks.where("stays").select(keys)), own, "left_semi")
                    .groupBy(own).agg(F.first(F.struct(*docs.columns)).alias("row")).select("row.*"))
    return rows.join(_met(marks.select(keys)), own, "left_anti").select(*docs.columns).unionByName(repeated)


def remainder(id_col: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``: the contract's fold of a row."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def slices(batches: Iterable[pa.RecordBatch], text_col: str = "text",
           most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Arrow batches cut into runs of rows with about ``most`` bytes of text, each with its
    texts as UTF-8 bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = pc.fill_null(batch.column(text_col), "").cast(pa.large_string()).cast(pa.large_binary())
        sizes = pc.binary_length(text).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > most:
                yield batch.slice(start, i - start), text.slice(start, i - start).to_pylist()
                start, total = i, 0
            total += n
        yield batch.slice(start), text.slice(start).to_pylist()
    # workers live on for later stages: hand back what this one no longer needs
    pa.default_memory_pool().release_unused()


def map_arrow(df: DataFrame, fn: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: str) -> DataFrame:
    """``mapInArrow`` with the package shipped; ``fn`` yields batches in ``schema``'s order."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def batch_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``groups`` (one row per ``key``; ``size``: how many of the
    ``total`` rows carry it). Keys of over a thousandth of the rows, of which there are fewer
    than a thousand, are broadcast, so that no hot key's rows meet in one task; the rest go
    through an ordinary equi-join."""
    hot = groups.where(F.col(size) > max(1000, total // 1000))
    common = F.broadcast(hot)
    rare = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return (rows.join(common, key, "inner")
                .unionByName(rare.join(groups.where(F.col(size) <= max(1000, total // 1000)), key, how)))
