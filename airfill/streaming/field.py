"""The field kept up to date as conditions arrive (ST7).

Conditions are stored by cell and hour, the field by hour. A micro-batch of new conditions is merged
into the stored ones, and the hours it touches - at most those of the window - are computed
again from the stored conditions of just these hours and swapped in; the files of other hours
are not read or written. A repeated batch merges the same rows and writes the same hours."""

from __future__ import annotations

import os

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airfill.functions import display as D
from airfill.plans import field as FLD
from airfill.session import scratch_path, written
from airfill.sources.fixtures import Fixtures
from airfill.sources.sinks import upsert
from airfill.streaming.panes import FILES, drain
from airfill.streaming.readings import LATE, stage_files

CONDITIONS = ["temp", "wind_dir", "cams_no2", "cams_pm25"]
ARRIVAL_SCHEMA = T.StructType([
    T.StructField("clat", T.DoubleType()),
    T.StructField("clon", T.DoubleType()),
    T.StructField("valid_time", T.TimestampType()),
    *[T.StructField(c, T.DoubleType()) for c in CONDITIONS],
])
_HOUR = "yyyyMMddHH"


class FieldTable:
    """The stored field of one window of hours under ``root``. ``grid``: row, col, lat, lon, cell_id, dist_km of
    every point; ``hours``: the window's hours."""

    def __init__(self, spark: SparkSession, root: str, grid: DataFrame, hours: list, models: dict[str, PipelineModel] | None = None):
        self.spark, self.root, self.models = spark, root, models
        self.grid, self.hours = grid, hours
        self.path, self.stored = os.path.join(root, "field"), os.path.join(root, "conditions")

    def write(self, hours: list, known: DataFrame) -> None:
        """Compute the field of ``hours`` from the conditions ``known`` (cell_id, valid_time, ...) and swap it in."""
        at = self.grid.withColumn("valid_time", F.explode(F.array(*[F.lit(h) for h in hours])))
        cond = at.join(known.select("cell_id", "valid_time", *CONDITIONS), ["cell_id", "valid_time"], "left").drop("cell_id")
        if self.models:  # read once per pollutant by the model stages
            cond = written(cond, "field-conditions")
        parts = [FLD.predicted(cond, p, (self.models or {}).get(p)) for p in FLD.POLLUTANTS]
        field = parts[0].unionByName(parts[1]).withColumns({
            "trust": D.trust_class(F.col("dist_km")), "status": F.lit("model" if self.models else "cams-prior"),
            "hour": F.date_format("valid_time", _HOUR)})
        (field.select(*FLD.FIELD_COLUMNS, "hour").repartition(len(hours), "hour").write.mode("overwrite")
              .option("partitionOverwriteMode", "dynamic").partitionBy("hour").parquet(self.path))

    def start(self) -> None:
        """Every point and hour without a value: nothing has arrived yet."""
        none = self.spark.createDataFrame([], "cell_id long, valid_time timestamp_ntz, temp double, wind_dir double, "
                                              "cams_no2 double, cams_pm25 double")
        self.write(self.hours, none)

    def refresh(self, batch: DataFrame, _epoch: int = 0) -> list:
        """Take the conditions of ``batch`` in and write the hours they touch; returns those hours."""
        new = (batch.withColumn("valid_time", F.date_trunc("HOUR", F.col("valid_time").cast("timestamp_ntz")).cast("timestamp_ntz"))
                    .where(F.col("valid_time").between(F.lit(self.hours[0]), F.lit(self.hours[-1])))
                    .select(FLD.cell_id().alias("cell_id"), "valid_time", *CONDITIONS, F.date_format("valid_time", _HOUR).alias("hour")))
        touched = sorted(r[0] for r in new.select("valid_time").distinct().collect())  # at most the window's hours
        if touched:
            upsert(new, self.stored, ["cell_id", "valid_time"], [F.lit(0)], "hour", os.path.join(self.root, "staging"))
            # named by their folder, so that other hours' conditions are not listed as input
            known = self.spark.read.schema(new.schema).parquet(self.stored).where(
                F.col("hour").isin([t.strftime("%Y%m%d%H") for t in touched]))
            self.write(touched, known)
        return touched

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).select(*FLD.FIELD_COLUMNS)


def field_table(fx: Fixtures, root: str, now: str | None = None, models: dict[str, PipelineModel] | None = None) -> FieldTable:
    """An empty field for the window around ``now``. What doesn't change with conditions - each point's
    weather cell and its distance to the nearest station - is computed once."""
    grid = written(FLD.grid_with_cells(fx).join(FLD.grid_distance(fx).select("row", "col", "dist_km"), ["row", "col"], "left"), "field-grid")
    hours = [r["valid_time"] for r in FLD.hours_around(fx, now).select(
        F.explode(F.sequence("first_hour", "last_hour", F.expr("INTERVAL 1 HOUR"))).alias("valid_time")).collect()]
    return FieldTable(fx.spark, root, grid, hours, models)


def refreshed_field(fx: Fixtures, now: str | None = None, late: int = LATE) -> DataFrame:
    """ST7: the field after all conditions have arrived, in deliveries that follow time and a last one with
    conditions that were held up."""
    spark, root = fx.spark, scratch_path(fx.spark, "st7")
    arrivals = fx.cell_weather.select("clat", "clon", "valid_time", *CONDITIONS)
    src = stage_files(arrivals, os.path.join(root, "in"), "valid_time", late=late,
                      key=F.crc32(F.concat_ws(":", "clat", "clon", "valid_time").cast("binary")))
    table = field_table(fx, root, now)
    table.start()
    feed = spark.readStream.schema(ARRIVAL_SCHEMA).option("maxFilesPerTrigger", FILES).parquet(src)
    drain(feed.writeStream.foreachBatch(lambda batch, epoch: table.refresh(batch, epoch) and None), os.path.join(root, "ckpt"))
    return table.read()
