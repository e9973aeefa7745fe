"""Label and feature tables (Q1, Q2, Q9)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airfill.functions.geo import cell_index, snap
from airfill.operators import readings as R
from airfill.session import written
from airfill.sources.fixtures import Fixtures

# Fixed values
CELL_DEG = 0.25
COUNTRIES = ("AL", "BA", "BE", "LU", "MT")
COUNTRY_NAMES = {"AL": "Albania", "BA": "Bosnia and Herzegovina", "BE": "Belgium", "LU": "Luxembourg", "MT": "Malta"}
POLLUTANTS = ("pm25", "no2")


def stations(fx: Fixtures) -> DataFrame:
    """Placed NO2 / PM2.5 stations (AG1 over the metadata points)."""
    return R.station_metadata(fx.station_points, ("NO2", "PM2.5"))


def labels(fx: Fixtures, min_year: int = R.MIN_YEAR) -> DataFrame:
    """Q1: the label table."""
    return R.label_table(fx.raw_readings, stations(fx), min_year=min_year)


def labels_from_files(fx: Fixtures) -> DataFrame:
    """SC1 to Q1: the readings as delivered - files of either dataset and pollutant with values
    stored as text, double and decimal, and one broken file - read back and made labels."""
    from airfill.session import scratch_path
    from airfill.sources.readers import read_readings
    spark, root = fx.spark, scratch_path(fx.spark, "readings")
    raw = fx.raw_readings.withColumn("_number", F.col("value_text").try_cast("double"))
    kind = F.when(F.col("_number").isNull(), 0).otherwise(F.pmod("row_id", F.lit(3)))
    raw = written(raw.withColumn("_kind", kind), "readings-raw")
    files = []
    for k, stored in enumerate(("string", "double", "decimal(12,1)")):
        value = F.col("value_text") if stored == "string" else F.col("_number").cast(stored)
        (raw.where(F.col("_kind") == k).select(
            F.col("samplingpoint").alias("Samplingpoint"), F.col("start_time").alias("Start"),
            (F.col("start_time") + F.expr("INTERVAL 1 HOUR")).alias("End"), value.alias("Value"),
            F.col("validity").cast("int").alias("Validity"), "row_id", "dataset", "pollutant")
            .write.partitionBy("dataset", "pollutant").parquet(f"{root}/{k}"))
        files.append(f"{root}/{k}")
    broken = f"{root}/broken"
    spark.range(1).selectExpr("'not a parquet file' value").write.text(broken)
    got, skipped = read_readings(spark, [*files, broken], row_id="row_id")
    if [p for p, _ in skipped] != [broken]:
        raise ValueError(f"files left out: {skipped}")
    return R.label_table(got, stations(fx))


def cell_id(lat: str = "clat", lon: str = "clon") -> Column:
    """The weather cell that holds a place (F2), as one number."""
    return cell_index(F.col(lat), CELL_DEG) * F.lit(100000) + cell_index(F.col(lon), CELL_DEG)


def cells_to_stations(cells: DataFrame, stations_df: DataFrame, cell_deg: float = CELL_DEG,
                      cell_lat: str = "clat", cell_lon: str = "clon") -> DataFrame:
    """Fan each cell's series out to every station inside the cell, keeping the
    stations' real coordinates. The join key is the integer cell index (F2), never a
    rounded double."""
    st = stations_df.select("station_eoi", "lat", "lon",
                            cell_index(F.col("lat"), cell_deg).alias("_ci"),
                            cell_index(F.col("lon"), cell_deg).alias("_cj"))
    cs = cells.withColumns({"_ci": cell_index(F.col(cell_lat), cell_deg),
                            "_cj": cell_index(F.col(cell_lon), cell_deg)}).drop(cell_lat, cell_lon)
    return cs.join(st, ["_ci", "_cj"], "inner").drop("_ci", "_cj")


def cells_needed(fx: Fixtures, cell_deg: float = CELL_DEG) -> DataFrame:
    """AG12: the weather cells that hold a station, with how many they serve."""
    st = stations(fx)
    return (st.groupBy(snap(F.col("lat"), cell_deg).alias("clat"), snap(F.col("lon"), cell_deg).alias("clon"))
              .agg(F.count(F.lit(1)).alias("stations")))


def days_to_do(fx: Fixtures, stored_days: int = 10) -> DataFrame:
    """P15 / T-2: days of the label period that aren't stored yet, oldest first, with their place
    in the queue, when the first ``stored_days`` days are."""
    # one row, written: both the days and those stored are made from it, the labels once
    span = written(labels(fx).agg(F.min(F.to_date("start_time")).alias("lo"), F.max(F.to_date("start_time")).alias("hi")), "label-span")
    days = span.where(F.col("lo").isNotNull()).select("lo", F.explode(F.sequence("lo", "hi")).alias("day"))
    stored = days.where(F.col("day") < F.date_add("lo", stored_days)).select("day")
    left = days.join(stored, "day", "left_anti")
    return left.select("day", (F.date_diff("day", "lo") - stored_days + 1).cast("long").alias("place")).orderBy("day")


def station_features(fx: Fixtures) -> DataFrame:
    """Q2: hourly weather + prior per station (P7: hours lacking a prior dropped)."""
    cw = R.drop_missing_prior(fx.cell_weather)
    fanned = cells_to_stations(cw, stations(fx))
    return fanned.select("station_eoi", "valid_time", "lat", "lon", "temp", "wind_dir",
                         "cams_no2", "cams_pm25")


def station_state(fx: Fixtures, now=None, days: int = 21,
                  countries: Sequence[str] = COUNTRIES) -> DataFrame:
    """Q9: stations of the countries with the latest reading of each pollutant seen in
    the ``days`` before ``now`` (SC7 + AG4 + J12). ``now`` defaults to the newest label.

    ``obs_ts`` is the time of the PM2.5 reading when there is one, else NO2 (the last
    pollutant written wins in the source)."""
    st = R.in_countries(stations(fx), countries)
    lab = labels(fx).select("station_eoi", "pollutant", "value", "start_time")
    recent = R.read_since(lab, "start_time", days, now).filter(F.col("pollutant").isin(list(POLLUTANTS)))
    last = R.latest_per_key(recent, ["station_eoi", "pollutant"], "start_time", ["value"])
    wide = (last.groupBy("station_eoi")
                .pivot("pollutant", list(POLLUTANTS))
                .agg(F.first(F.round("value", 1)).alias("v"), F.first("start_time").alias("t")))
    out = st.join(wide, "station_eoi", "left")
    return out.select(
        F.col("station_eoi").alias("eoi"), F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"),
        F.coalesce(F.col("station_area"), F.lit("")).alias("area"),
        F.coalesce(F.col("station_type"), F.lit("")).alias("type"),
        F.col("pm25_v").alias("pm25"), F.col("no2_v").alias("no2"),
        F.date_format(F.coalesce(F.col("pm25_t"), F.col("no2_t")), "yyyy-MM-dd HH:mm").alias("obs_ts"))


def upsert_labels(fx: Fixtures) -> DataFrame:
    """SK1 end to end: the up-to-date dataset is stored first, the verified dataset is
    then upserted over it (only the touched day partitions are rewritten); the stored
    table equals the deduplicated label table."""
    from airfill.session import scratch_path
    from airfill.sources.sinks import upsert
    root = scratch_path(fx.spark, "labels")
    table = f"{root}/table"
    rows = R.label_rows(fx.raw_readings, stations(fx)).withColumn("day", F.to_date("start_time"))
    for ds in (1, 2):
        upsert(rows.filter(F.col("dataset") == ds), table, R.LABEL_KEYS, R.label_order(), "day",
               f"{root}/staging")
    return fx.spark.read.schema(rows.schema).parquet(table).select(*R.LABEL_COLUMNS)


def labels_not_stored(fx: Fixtures, stored_days: int = 10) -> DataFrame:
    """SK2 / J5: resume - label rows of (station, day) pairs not yet stored, when the
    first ``stored_days`` days are already in the store."""
    from airfill.sources.sinks import only_new
    lab = labels(fx).withColumn("day", F.to_date("start_time"))
    stored = fx.spark.sql(f"SELECT * FROM {{l}} WHERE day < (SELECT min(day) FROM {{l}}) + {int(stored_days)}", l=lab)
    return only_new(lab, stored, ["station_eoi", "day"]).drop("day")


def label_counts(fx: Fixtures) -> DataFrame:
    """AG11 / SK5: rows and stations per pollutant (the peek summary)."""
    return (labels(fx).groupBy("pollutant")
                      .agg(F.count(F.lit(1)).alias("n"), F.count_distinct("station_eoi").alias("stations")))
