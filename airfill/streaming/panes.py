"""Hourly panes of mergeable sums over a feed with late and repeated rows (ST4, ST6, ST8), and
sliding windows made from panes.

A pane is one row per series and hour: how many rows, and their sums. Two queries read the same
deliveries in the same order. The first keeps open panes as state, forgets them two hours behind the
newest row, and upserts what a micro-batch changed. Rows later than that never reach a
pane; the second query, which keeps no state, finds them by the newest time of the batches before,
and recomputes just the panes they touch from the stored deliveries, read within their
hours only. Of two versions of a pane the one with more rows wins, so the order in which the
queries write, or a repeated batch, doesn't change the table."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airfill.sources.sinks import upsert

WATERMARK = "2 hours"
#: Files of a delivery, and of a micro-batch.
FILES = 8
PANE = "1 hour"


class Feed(NamedTuple):
    """A folder that deliveries of Parquet files arrive in. Rows with the same ``identity`` are one row
    that came more than once."""

    path: str
    schema: T.StructType
    time_col: str
    identity: list[str]
    files: int = FILES

    def stream(self, spark: SparkSession) -> DataFrame:
        """One delivery per micro-batch at most, so that watermarks advance between batches."""
        return (spark.readStream.schema(self.schema).option("maxFilesPerTrigger", self.files)
                     .option("recursiveFileLookup", "true").parquet(self.path))

    def stored(self, spark: SparkSession, first: Column | None = None, end: Column | None = None) -> DataFrame:
        """What has arrived, each row once, of times in [first, end)."""
        df = spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.path)
        if first is not None:
            df = df.where((F.col(self.time_col) >= first) & (F.col(self.time_col) < end))
        return df.dropDuplicates(self.identity)


def drain(writer, ckpt: str) -> None:
    """Run a streaming query until it has read what is there."""
    q = writer.option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def on_late_rows(spark: SparkSession, feed: Feed, root: str, amend: Callable[[DataFrame, Column, Column], None],
                 watermark: str = WATERMARK) -> None:
    """ST8: for each delivery, ``amend(late, first, last)`` with its rows that a query with this
    ``watermark`` over the same feed drops, and their least and greatest time. The newest time so far
    is one stored row per delivery, written anew if a delivery is repeated."""
    seen = os.path.join(root, "seen")
    t = F.col(feed.time_col)

    def look(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()  # read for its newest row, then for its late ones
        try:
            before = None
            if epoch:
                before = spark.read.schema("newest timestamp").parquet(f"{seen}/{epoch - 1}").first()["newest"]
            own = batch.agg(F.greatest(F.max(t), F.lit(before).cast("timestamp")).alias("newest"))
            own.coalesce(1).write.mode("overwrite").parquet(f"{seen}/{epoch}")
            if before is None:
                return
            late = batch.where(t <= F.lit(before) - F.expr(f"INTERVAL {watermark}") + F.expr("INTERVAL 1 SECOND"))
            first, last = late.agg(F.min(t), F.max(t)).first()
            if first is not None:
                amend(late, F.lit(first), F.lit(last))
        finally:
            batch.unpersist()

    drain(feed.stream(spark).writeStream.foreachBatch(look), os.path.join(root, "ckpt-late"))


def panes(df: DataFrame, time_col: str, keys: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """One row per series and hour: keys, window_start, n and the sums."""
    return (df.groupBy(*keys, F.window(time_col, PANE).alias("_w"))
              .agg(F.count(F.lit(1)).alias("n"), *[F.sum(e).alias(k) for k, e in sums.items()])
              .select(*keys, F.col("_w.start").alias("window_start"), "n", *sums))


def pane_stream(spark: SparkSession, feed: Feed, keys: Sequence[str], sums: Mapping[str, Column], root: str,
                watermark: str = WATERMARK) -> DataFrame:
    """Drain ``feed`` into a table of panes under ``root``, partitioned by day; returns the table."""
    table, staging = os.path.join(root, "panes"), os.path.join(root, "staging")
    key = [*keys, "window_start"]

    def merge(batch: DataFrame, _epoch: int = 0) -> None:
        upsert(batch.withColumn("day", F.to_date("window_start")), table, key, [F.col("n")], "day", staging)

    once = feed.stream(spark).withWatermark(feed.time_col, watermark).dropDuplicatesWithinWatermark(feed.identity)
    drain(panes(once, feed.time_col, keys, sums).writeStream.outputMode("update").foreachBatch(merge), os.path.join(root, "ckpt"))

    def amend(late: DataFrame, first: Column, last: Column) -> None:
        hour = F.window(feed.time_col, PANE)["start"].alias("window_start")
        touched = late.select(*keys, hour).distinct()
        whole = F.expr("INTERVAL 1 HOUR")
        stored = feed.stored(spark, first - whole, last + whole)
        again = stored.withColumn("window_start", F.window(feed.time_col, PANE)["start"]).join(touched, key, "left_semi")
        merge(panes(again.drop("window_start"), feed.time_col, keys, sums))

    on_late_rows(spark, feed, root, amend, watermark)
    return spark.read.parquet(table).select(*key, "n", *sums)


def sliding(table: DataFrame, keys: Sequence[str], sums: Sequence[str], hours: int) -> DataFrame:
    """Windows of ``hours`` hours that start at every hour, for each series every window with a row in
    it: keys, window_start, n and the sums. Each pane gathers those of the hours before it by a range
    frame over the series' hours, and gives the windows that end from its hour up to the next
    pane; panes are sorted once, windows never. A series has as many rows as hours, however
    many readings it has."""
    hour = F.expr("INTERVAL 1 HOUR")
    reach = F.expr(f"INTERVAL {hours - 1} HOURS")
    counted = ["n", *sums]
    kinds = {f.name: f.dataType for f in table.agg(*[F.sum(c).alias(c) for c in counted]).schema}
    series = Window.partitionBy(*keys).orderBy("_t")
    panes_of = table.withColumn("_t", F.col("window_start").cast("long")).withColumns({
        "_held": F.collect_list(F.struct("window_start", *counted)).over(series.rangeBetween(-3600 * (hours - 1), 0)),
        # the hours that a window with some pane can end in: up to the next pane, at most the window's length
        "_last": F.least(F.col("window_start") + reach, F.coalesce(F.lead("window_start").over(series) - hour, F.col("window_start") + reach))})

    def added(c: str):
        return lambda a, x: F.when(x[c].isNull(), a).otherwise(F.coalesce(a, F.lit(0).cast(kinds[c])) + x[c])

    def merged(end: Column) -> list[Column]:
        inside = F.filter("_held", lambda x: x["window_start"] >= end - reach)
        return [F.aggregate(inside, F.lit(None).cast(kinds[c]), added(c)).alias(c) for c in counted]

    windows = F.transform(F.sequence("window_start", "_last", hour), lambda end: F.struct((end - reach).alias("window_start"), *merged(end)))
    return panes_of.select(*keys, F.explode(windows).alias("_x")).select(*keys, "_x.*")
