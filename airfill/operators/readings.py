"""Reading and station operators (P1-P7, P13, F1, AG1, AG2, AG4, J1, J12).

Every function is DataFrame in, DataFrame out, lazy. Deduplication and latest-per-key
use ``max_by`` aggregates so Spark pre-aggregates on the map side before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airfill.functions.text import country_code, finite, read_number, station_code, to_number

# Fixed values
# exclusive physical label bounds per pollutant
LABEL_BOUNDS = {"no2": (0.0, 500.0), "pm25": (0.0, 800.0)}
# first year of labels
MIN_YEAR = 2019
LABEL_COLUMNS = ["sampling_point", "station_eoi", "pollutant", "value", "lat", "lon",
                 "altitude", "station_area", "station_type", "country", "start_time",
                 "end_time", "validity"]


def first_non_null(cols: Iterable[str], order: Column) -> list[Column]:
    """AG1/T1: per column, the value of the first row (by ``order``) where it is not NULL.

    ``min_by`` skips rows whose ordering is NULL, so masking the order masks the row;
    one output row may combine values of different input rows, as in the source."""
    return [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in cols]


def station_metadata(points: DataFrame, notations: Sequence[str] = ("NO2", "PM2.5")) -> DataFrame:
    """P5 + P2 + AG1: one row per station measuring any of ``notations``.

    ``points`` has one row per sampling point with text coordinates
    (station_eoi, air_pollutant, lat_text, lon_text, altitude_text, station_area,
    station_type). Rows without a station code or a numeric lat/lon are dropped."""
    p = (points
         .filter(F.col("air_pollutant").isin(list(notations)))
         .select("station_eoi", "air_pollutant",
                 to_number(F.col("lat_text")).alias("lat"),
                 to_number(F.col("lon_text")).alias("lon"),
                 to_number(F.col("altitude_text")).alias("altitude"),
                 "station_area", "station_type")
         .filter(F.col("station_eoi").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull()))
    return (p.groupBy("station_eoi")
             .agg(*first_non_null(["lon", "lat", "altitude", "station_area", "station_type"],
                                  F.col("air_pollutant"))))


def clean_readings(raw: DataFrame, min_year: int | None = None) -> DataFrame:
    """P1 + P2 + F1 + P3: valid rows with a finite numeric value and a station code.

    ``raw`` columns: samplingpoint, pollutant, start_time, value_text, validity (+ any).
    The year bound is rewritten as a timestamp comparison so it reaches the scan."""
    return _valued(raw, min_year).withColumn("station_eoi", code_column("samplingpoint"))


def valid_readings(raw: DataFrame, min_year: int | None = MIN_YEAR) -> DataFrame:
    """P1 + P3 without the values: rows that are valid and not too old."""
    df = raw.filter(F.col("validity") >= 1)
    if min_year is not None:
        df = df.filter(F.col("start_time") >= F.make_timestamp_ntz(
            F.lit(min_year), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    return df


def _valued(raw: DataFrame, min_year: int | None) -> DataFrame:
    df = valid_readings(raw, min_year)
    # exploded, the text is read once; a filter on a column reads it again for each mention, and one inside
    # the array runs outside the generated code
    return df.withColumn("value", F.explode(F.array(read_number("value_text")))).filter(finite(F.col("value")))


def code_column(sampling_point: str) -> Column:
    """F1 as a column of its own: exploded, because a join asks for codes that aren't NULL, and Spark would move
    that question to where the rows are read, with the whole expression once more for each mention."""
    return F.explode(F.array(station_code(F.col(sampling_point))))


def place_on_stations(readings: DataFrame, meta: DataFrame) -> DataFrame:
    """Inner join on station code; readings that cannot be placed are dropped.

    No broadcast hint: the metadata grows with the network, so the join strategy is
    left to AQE, which switches to a broadcast only when the runtime size is small."""
    return readings.join(meta, "station_eoi", "inner")


def dedupe_latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """AG2/W3: one row per key, the one with the greatest ``order`` tuple.

    Meant for near-unique keys (a reading per sampling point and hour, a table key):
    every group is a handful of rows, so one shuffle and one sort on the key beat a
    sort-based struct aggregate. The key's hash leads the sort, because text keys share their
    first bytes; the first row is the one without a row before it, because a filter on the row number
    would sort all rows a first time before the shuffle, to leave out hardly any.
    Latest-per-key over big groups (a whole station) uses ``latest_per_key`` instead, which
    combines map-side."""
    w = Window.partitionBy(F.xxhash64(*keys), *keys).orderBy(*[o.desc() for o in order])
    return df.withColumn("_prev", F.lag(F.lit(True)).over(w)).filter(F.col("_prev").isNull()).drop("_prev")


def label_rows(raw: DataFrame, meta: DataFrame, min_year: int | None = MIN_YEAR) -> DataFrame:
    """Q1 before deduplication: placed, shaped rows plus ``dataset`` and ``row_id``. The end is
    the file's own where it has one, else an hour after the start."""
    placed = place_on_stations(clean_readings(raw, min_year), meta).withColumnRenamed("samplingpoint", "sampling_point")
    return _shaped(placed).select(*LABEL_COLUMNS, "dataset", "row_id")


def _shaped(placed: DataFrame) -> DataFrame:
    """Placed readings with the country, the end and the validity of a label."""
    hour = F.col("start_time") + F.expr("INTERVAL 1 HOUR")
    end = F.coalesce(F.col("end_time"), hour) if "end_time" in placed.columns else hour
    return placed.withColumns({"country": country_code(F.col("station_eoi")), "end_time": end,
                               "validity": F.col("validity").cast("long")})


# which of two rows for the same key wins: verified dataset, lowest row id, then the
# higher validity and the lower value (row ids can repeat)
def label_order() -> list[Column]:
    return [F.col("dataset"), -F.col("row_id"), F.col("validity"), -F.col("value")]


LABEL_KEYS = ["sampling_point", "start_time"]


def label_candidates(raw: DataFrame, min_year: int | None = MIN_YEAR) -> DataFrame:
    """Q1 before rows are told apart and placed: clean rows with what ``label_order`` reads."""
    return _valued(raw, min_year).select(
        F.col("samplingpoint").alias("sampling_point"), "pollutant", "value", "start_time",
        *[c for c in ["end_time"] if c in raw.columns], F.col("validity").cast("long").alias("validity"), "dataset", "row_id")


def label_table(raw: DataFrame, meta: DataFrame, min_year: int | None = MIN_YEAR) -> DataFrame:
    """Q1: hourly labels placed on stations, globally deduplicated (T2: verified
    dataset 2 wins over up-to-date dataset 1, then the lowest row id; row ids can
    repeat, so the higher validity and then the lower value break the last ties)."""
    # a key's rows have one station: they are told apart without its columns, and placed afterwards
    deduped = (dedupe_latest(label_candidates(raw, min_year), LABEL_KEYS, label_order())
               .withColumn("station_eoi", code_column("sampling_point")))
    return _shaped(place_on_stations(deduped, meta)).select(*LABEL_COLUMNS)


def within_bounds(df: DataFrame, value: str = "value", pollutant: str = "pollutant",
                  bounds: dict | None = None) -> DataFrame:
    """Keep labels strictly inside the physical bounds of their pollutant."""
    bounds = bounds or LABEL_BOUNDS
    cond = None
    for pol, (lo, hi) in bounds.items():
        c = (F.col(pollutant) == pol) & (F.col(value) > lo) & (F.col(value) < hi)
        cond = c if cond is None else cond | c
    return df.filter(cond)


def latest_per_key(df: DataFrame, keys: Sequence[str], time_col: str, cols: Sequence[str]) -> DataFrame:
    """AG4: latest row per key with its time, by ``max_by`` (ties: greatest values)."""
    packed = df.groupBy(*keys).agg(
        F.max_by(F.struct(F.col(time_col), *[F.col(c) for c in cols]),
                 F.col(time_col)).alias("_last"))
    return packed.select(*keys, F.col(f"_last.{time_col}").alias(time_col),
                         *[F.col(f"_last.{c}").alias(c) for c in cols])


def in_countries(df: DataFrame, countries: Sequence[str], code_col: str = "station_eoi") -> DataFrame:
    """Stations of the given countries (first two letters of the code)."""
    return df.filter(country_code(F.col(code_col)).isin(list(countries)))


def drop_missing_prior(df: DataFrame, priors: Sequence[str] = ("cams_no2", "cams_pm25")) -> DataFrame:
    """Hours lacking either prior are dropped."""
    return df.na.drop("any", subset=list(priors))


def min_rows_per_group(df: DataFrame, group: str, n: int) -> DataFrame:
    """Drop groups with fewer than ``n`` rows (count per group, broadcast back:
    the group table has one row per pollutant)."""
    keep = enough_rows(df.groupBy(group).count(), n).select(group)
    return df.join(F.broadcast(keep), group, "left_semi")


def enough_rows(counted: DataFrame, n: int, count: str = "count") -> DataFrame:
    """P14 where a result counts its groups' rows itself: the groups with at least ``n``."""
    return counted.filter(F.col(count) >= n)


def read_since(df: DataFrame, time_col: str, days: int, now=None) -> DataFrame:
    """SC7: rows of the last ``days`` before ``now`` (default: the newest row).

    The bound is a scalar subquery: Spark runs it once and the comparison becomes an
    ordinary filter that reaches the parquet scan; no join, nothing through the driver."""
    spark = df.sparkSession
    if now is None:
        return spark.sql(
            f"SELECT * FROM {{d}} WHERE {time_col} >= "
            f"(SELECT max({time_col}) FROM {{d}}) - INTERVAL {int(days)} DAYS", d=df)
    return df.filter(F.col(time_col) >= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS"))


def sampled(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """The ``n`` rows whose key has the least digest under ``seed`` (ties: by key): the same rows however ``df``
    is partitioned. Each task keeps its ``n`` least, and only these meet."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col(key)).cast("binary"))
    return df.orderBy(digest, key).limit(n)
