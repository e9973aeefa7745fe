"""Structured Streaming forms (ST1-ST6, ST8).

The source is a folder of Parquet files (new files = new readings). Event time must be
``TIMESTAMP`` for a watermark, so the stream casts ``TIMESTAMP_NTZ`` with the session
zone and casts back on output. Every query here runs with ``availableNow`` (drain what
is there, then stop) and writes to shared storage; the callers read the sink back as
a batch DataFrame.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airfill.operators.asof import asof_join
from airfill.session import scratch_path
from airfill.sources.sinks import upsert
from airfill.streaming.panes import FILES, WATERMARK, Feed, drain, on_late_rows, pane_stream, sliding

# Fixed values
READING_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("station_eoi", T.StringType()),
    T.StructField("pollutant", T.StringType()),
    T.StructField("start_time", T.TimestampType()),
    T.StructField("value", T.DoubleType()),
])
PREDICTION_SCHEMA = T.StructType([
    T.StructField("station_eoi", T.StringType()),
    T.StructField("pollutant", T.StringType()),
    T.StructField("valid_time", T.TimestampType()),
    T.StructField("predicted", T.DoubleType()),
    T.StructField("prior", T.DoubleType()),
])
SCORED_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("station_eoi", T.StringType()),
    T.StructField("pollutant", T.StringType()),
    T.StructField("valid_time", T.TimestampType()),
    T.StructField("start_time", T.TimestampType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("predicted", T.DoubleType()),
    T.StructField("prior", T.DoubleType()),
])
#: Of a fed table one row in so many comes late; hours of a sliding window; folders of a latest-state table.
LATE, SLIDING_HOURS, BUCKETS = 50, 24, 16


def stage_files(df: DataFrame, path: str, time_col: str, chunks: int = 4, files: int = FILES,
                key: str | Column | None = None, late: int = 0) -> str:
    """Write ``df`` as ``chunks`` deliveries that follow event time, ``files`` files each, rows
    in no order within a delivery. Event time is cast to TIMESTAMP.

    ``late`` > 0 makes it an at-least-once feed with late rows: every delivery brings the
    last hour of the one before again, and rows whose ``key`` is divisible by ``late`` come
    a last time, and for the first time, in a delivery of their own at the end."""
    data = df.withColumn(time_col, F.col(time_col).cast("timestamp"))
    bounds = data.select(F.min(time_col).cast("double").alias("a"), F.max(time_col).cast("double").alias("b")).first()
    lo, hi = bounds["a"], bounds["b"]
    if lo is None:
        data.limit(0).write.mode("append").parquet(path)
        return path
    step = (hi - lo) / chunks or 1.0
    t = F.col(time_col).cast("double")
    held = F.pmod(F.col(key) if isinstance(key, str) else key, F.lit(late)) == 0 if late else F.lit(False)
    again = 3600.0 if late else 0.0
    for i in range(chunks):
        cond = (t >= lo + i * step - again) & ((t < lo + (i + 1) * step) if i < chunks - 1 else F.lit(True)) & ~held
        data.filter(cond).repartition(files).write.mode("append").parquet(path)
    if late:
        data.filter(held).repartition(files).write.mode("append").parquet(path)
    return path


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files: int = FILES) -> DataFrame:
    """File source, one delivery of ``files`` files per micro-batch at most (so watermarks
    advance between batches)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def _ntz(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


STREAM_KEY = ["station_eoi", "pollutant", "start_time"]


def dedupe_stream(spark: SparkSession, readings: DataFrame, watermark: str = WATERMARK, late: int = 50) -> DataFrame:
    """ST1 + ST8: clean (finite value) and deduplicate a redelivered, unordered reading stream on
    (station, pollutant, event time) within the watermark into a Parquet sink. Rows later
    than the watermark, which the stream has to drop, are then found in the source by their
    missing key and upserted (SK1), so that the table holds what a batch run would."""
    root = scratch_path(spark, "st1")
    src = stage_files(readings, os.path.join(root, "in"), "start_time", key="event_id", late=late)
    v = F.col("value")

    def clean(df: DataFrame) -> DataFrame:
        return df.filter(v.isNotNull() & ~F.isnan(v))

    s = (clean(read_stream(spark, src, READING_SCHEMA)).withWatermark("start_time", watermark)
         .dropDuplicatesWithinWatermark(STREAM_KEY))
    out = os.path.join(root, "out")
    drain(s.writeStream.format("parquet").option("path", out).outputMode("append"),
           os.path.join(root, "ckpt"))
    table = os.path.join(root, "table")
    live = spark.read.schema(READING_SCHEMA).parquet(out)
    day = F.to_date("start_time")
    upsert(live.withColumn("day", day), table, STREAM_KEY, [-F.col("event_id")], "day", os.path.join(root, "staging"))
    missed = clean(spark.read.schema(READING_SCHEMA).parquet(src)).join(live.select(*STREAM_KEY), STREAM_KEY, "left_anti")
    upsert(missed.withColumn("day", day), table, STREAM_KEY, [-F.col("event_id")], "day", os.path.join(root, "staging"))
    return _ntz(spark.read.parquet(table).select(*READING_SCHEMA.fieldNames()), "start_time")


def latest_stream(spark: SparkSession, readings: DataFrame) -> DataFrame:
    """ST2: latest reading per (station, pollutant), kept as a keyed table: the
    stateful aggregate runs in update mode and each micro-batch's changed keys are
    upserted (SK1) into a Parquet table partitioned by a hash of the station, so that a batch
    rewrites the folders of its stations only."""
    root = scratch_path(spark, "st2")
    src = stage_files(readings, os.path.join(root, "in"), "start_time")
    s = read_stream(spark, src, READING_SCHEMA)
    agg = (s.groupBy("station_eoi", "pollutant")
            .agg(F.max_by(F.struct("start_time", "value", "event_id"),
                          F.struct("start_time", "event_id")).alias("_l"))
            .select("station_eoi", "pollutant", "_l.start_time", "_l.value", "_l.event_id"))
    table = os.path.join(root, "table")

    def merge(batch: DataFrame, _epoch: int) -> None:
        bucket = F.pmod(F.xxhash64("station_eoi"), F.lit(BUCKETS)).cast("int")
        upsert(batch.withColumn("bucket", bucket), table, ["station_eoi", "pollutant"],
               [F.col("start_time"), F.col("event_id")], "bucket", os.path.join(root, "staging"))

    drain(agg.writeStream.outputMode("update").foreachBatch(merge), os.path.join(root, "ckpt"))
    return _ntz(spark.read.parquet(table), "start_time").select(
        "station_eoi", "pollutant", "start_time", "value", "event_id")


def hourly_panes(spark: SparkSession, readings: DataFrame, watermark: str = WATERMARK, late: int = LATE) -> DataFrame:
    """ST4 + ST8: the hourly panes (n, total) per station and pollutant of a feed with repeated and late
    rows; the table equals the batch aggregate."""
    root = scratch_path(spark, "st4")
    src = stage_files(readings, os.path.join(root, "in"), "start_time", key="event_id", late=late)
    return pane_stream(spark, Feed(src, READING_SCHEMA, "start_time", ["event_id"]), ["station_eoi", "pollutant"],
                       {"total": F.col("value")}, root, watermark)


def _means(table: DataFrame) -> DataFrame:
    return _ntz(table, "window_start").select("station_eoi", "pollutant", "window_start", F.col("n").cast("long").alias("n"),
                                              F.round(F.col("total") / F.col("n"), 6).alias("mean_value"))


def hourly_stream(spark: SparkSession, readings: DataFrame, watermark: str = WATERMARK, late: int = LATE) -> DataFrame:
    """ST4: tumbling one-hour mean per station and pollutant."""
    return _means(hourly_panes(spark, readings, watermark, late))


def sliding_stream(spark: SparkSession, readings: DataFrame, hours: int = SLIDING_HOURS, watermark: str = WATERMARK,
                   late: int = LATE) -> DataFrame:
    """ST4: mean of the last 24 hours at every hour, per station and pollutant, from the hourly panes."""
    return _means(sliding(hourly_panes(spark, readings, watermark, late), ["station_eoi", "pollutant"], ["total"], hours))


def _scored(r: DataFrame, p: DataFrame) -> DataFrame:
    """Readings beside the prediction for their station, pollutant and hour."""
    r, p = r.alias("r"), p.alias("p")
    same = ((F.col("r.station_eoi") == F.col("p.station_eoi")) & (F.col("r.pollutant") == F.col("p.pollutant"))
            & (F.col("r.start_time") >= F.col("p.valid_time"))
            & (F.col("r.start_time") < F.col("p.valid_time") + F.expr("INTERVAL 1 HOUR")))
    return r.join(p, same, "inner").select(*[F.col(f"{'p' if c in ('valid_time', 'predicted', 'prior') else 'r'}.{c}").alias(c)
                                             for c in SCORED_SCHEMA.fieldNames()])


def score_feeds(spark: SparkSession, predictions: DataFrame, readings: DataFrame, root: str, watermark: str = WATERMARK,
                late: int = LATE) -> tuple[DataFrame, Feed]:
    """ST5 + ST8: stream-stream join of hourly predictions with the readings of the same station
    and pollutant inside the predicted hour; both sides watermarked, the time bound lets Spark drop old
    state. Rows of either side that come too late are joined with what the other side has stored
    for their hours. Returns the scored table, one row per reading and hour, and the log it was made
    from: a feed in order of arrival, with rows that were scored more than once."""
    r = Feed(stage_files(readings, os.path.join(root, "in_r"), "start_time", key="event_id", late=late),
             READING_SCHEMA, "start_time", ["event_id"])
    p = Feed(stage_files(predictions, os.path.join(root, "in_p"), "valid_time", late=late,
                         key=F.crc32(F.concat("station_eoi", "pollutant", F.col("valid_time").cast("string")).cast("binary"))),
             PREDICTION_SCHEMA, "valid_time", ["station_eoi", "pollutant", "valid_time"])
    log, table = os.path.join(root, "log"), os.path.join(root, "table")

    def keep(name: str):
        def store(batch: DataFrame, epoch: int) -> None:
            # as many files as the log's feed reads at once: one delivery, however many tasks the join ran in
            batch.repartition(FILES).write.mode("overwrite").parquet(f"{log}/{name}-{epoch}")
            fresh = spark.read.schema(SCORED_SCHEMA).parquet(f"{log}/{name}-{epoch}")
            upsert(fresh.withColumn("day", F.to_date("valid_time")), table, ["event_id", "valid_time"], [F.col("predicted")],
                   "day", os.path.join(root, "staging"))
        return store

    both = _scored(r.stream(spark).withWatermark("start_time", watermark), p.stream(spark).withWatermark("valid_time", watermark))
    drain(both.writeStream.foreachBatch(keep("joined")), os.path.join(root, "ckpt"))
    hour = F.expr("INTERVAL 1 HOUR")
    amended = {"readings": 0, "predictions": 0}

    def late_readings(rows: DataFrame, first: Column, last: Column) -> None:
        keep("readings")(_scored(rows, p.stored(spark, first - hour, last + hour)), amended["readings"])
        amended["readings"] += 1

    def late_predictions(rows: DataFrame, first: Column, last: Column) -> None:
        keep("predictions")(_scored(r.stored(spark, first, last + hour), rows), amended["predictions"])
        amended["predictions"] += 1

    on_late_rows(spark, r, os.path.join(root, "late_r"), late_readings, watermark)
    on_late_rows(spark, p, os.path.join(root, "late_p"), late_predictions, watermark)
    return (spark.read.parquet(table).select(*SCORED_SCHEMA.fieldNames()),
            Feed(log, SCORED_SCHEMA, "valid_time", ["event_id", "valid_time"]))


def self_score_stream(spark: SparkSession, predictions: DataFrame, readings: DataFrame,
                      watermark: str = WATERMARK, late: int = LATE) -> DataFrame:
    """ST5: the scored readings."""
    table, _ = score_feeds(spark, predictions, readings, scratch_path(spark, "st5"), watermark, late)
    return _ntz(table, "valid_time", "start_time")


def rolling_error(spark: SparkSession, predictions: DataFrame, readings: DataFrame, hours: int = SLIDING_HOURS,
                  watermark: str = WATERMARK, late: int = LATE) -> DataFrame:
    """ST6: error of predictions and of the prior over the last 24 hours at every hour, per
    pollutant. The scored log of ST5 is a stream of its own, aggregated into hourly panes of mergeable
    error sums; what ST5 scored late is late here too and amends its panes."""
    root = scratch_path(spark, "st6")
    _, log = score_feeds(spark, predictions, readings, os.path.join(root, "score"), watermark, late)
    e, b = F.col("predicted") - F.col("value"), F.col("prior") - F.col("value")
    sums = {"squares": e * e, "absolutes": F.abs(e), "prior_squares": b * b}
    w = sliding(pane_stream(spark, log, ["pollutant"], sums, root, watermark), ["pollutant"], list(sums), hours)

    def mean(c: str) -> Column:
        return F.col(c) / F.col("n")

    return _ntz(w, "window_start").select(
        "pollutant", "window_start", F.col("n").cast("long").alias("n"), F.round(F.sqrt(mean("squares")), 6).alias("pred_rmse"),
        F.round(mean("absolutes"), 6).alias("pred_mae"), F.round(F.sqrt(mean("prior_squares")), 6).alias("prior_rmse"))


def enriched_stream(spark: SparkSession, readings: DataFrame, features: DataFrame,
                    feature_cols: list[str]) -> DataFrame:
    """ST3: each micro-batch of readings gets the latest stored features at or before
    its time (the batch as-of join J4; features read up to the batch's newest time)."""
    root = scratch_path(spark, "st3")
    src = stage_files(readings, os.path.join(root, "in"), "start_time")
    s = read_stream(spark, src, READING_SCHEMA)
    out = os.path.join(root, "out")

    def enrich(batch: DataFrame, epoch: int) -> None:
        b = _ntz(batch, "start_time")
        hi = b.agg(F.max("start_time")).first()[0]
        if hi is None:
            return
        f = features.filter(F.col("valid_time") <= F.lit(hi))
        # a folder per epoch, replaced if the epoch is run again
        (asof_join(b, f, "station_eoi", "start_time", "valid_time", feature_cols)
         .write.mode("overwrite").parquet(f"{out}/epoch={epoch}"))

    drain(s.writeStream.foreachBatch(enrich), os.path.join(root, "ckpt"))
    return spark.read.parquet(out).drop("epoch")


def live_error(scored: DataFrame, window: str = "1 day") -> DataFrame:
    """Live error per pollutant over the scored table in tumbling event-time windows of
    ``window``: rows, RMSE and MAE of prediction and of prior. ``rolling_error`` is the sliding form."""
    e = F.col("predicted") - F.col("value")
    b = F.col("prior") - F.col("value")
    w = F.window(F.col("valid_time").cast("timestamp"), window)
    return (scored.groupBy("pollutant", w.alias("w"))
                  .agg(F.count(F.lit(1)).alias("n"),
                       F.round(F.sqrt(F.avg(e * e)), 6).alias("pred_rmse"),
                       F.round(F.avg(F.abs(e)), 6).alias("pred_mae"),
                       F.round(F.sqrt(F.avg(b * b)), 6).alias("prior_rmse"))
                  .select("pollutant", F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                          "n", "pred_rmse", "pred_mae", "prior_rmse"))
