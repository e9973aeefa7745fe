"""Training set and evaluation reports (Q4, Q5 pieces: AG6-AG10, AG14, AG16, M9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airfill.functions.display import distance_bin
from airfill.functions.geo import snap
from airfill.functions.text import station_code
from airfill.operators import features as FE
from airfill.operators import metrics as M
from airfill.operators import readings as R
from airfill.operators.asof import asof_lookup
from airfill.operators.spatial import nearest_other
from airfill.plans import ingest
from airfill.session import sent_if_small, written
from airfill.sources.fixtures import Fixtures

# Fixed values
MIN_ROWS = 500
STATION_COLS = ["lat", "lon", "altitude", "station_area", "station_type"]
FEATURE_COLS = ["temp", "wind_dir", "cams_no2", "cams_pm25"]


def matched(fx: Fixtures) -> DataFrame:
    """J3 + J4: each label with the latest features (P7) of its station's cell at or before its hour. Stations
    of a cell share its series: a label brings its station's cell, so that no series is copied for each of them.
    Readings become labels (Q1) within that join: those of a key lie in one bucket of their cell, so they are
    shuffled and sorted once for both."""
    # small: written, so that it is known before the readings meet it
    cells = fx.shared("station-cells", lambda: ingest.stations(fx).select("station_eoi", ingest.cell_id("lat", "lon").alias("cell_id")))
    # read once, so they are not written: every cell's days stand for those that hold readings
    rows = R.label_candidates(fx.raw_readings).withColumn(
        "station_eoi", R.code_column("sampling_point")).join(sent_if_small(cells), "station_eoi").drop("station_eoi")
    days = fx.shared("reading-days", lambda: R.valid_readings(fx.raw_readings).select(F.to_date("start_time").alias("start_time")).distinct())
    cell_days = cells.select("cell_id").distinct().crossJoin(F.broadcast(days))  # a row a day
    feats = fx.shared("feature-rows", lambda: R.drop_missing_prior(fx.cell_weather).select(
        ingest.cell_id().alias("cell_id"), "valid_time", *FEATURE_COLS))
    met = asof_lookup(rows, feats, "cell_id", "start_time", "valid_time", FEATURE_COLS, left_buckets=cell_days, once=["sampling_point"],
                      order=R.label_order(), left_cols=["sampling_point", "pollutant", "value", "start_time"])
    return met.select(station_code("sampling_point").alias("station_eoi"), "pollutant", "value", "start_time", *FEATURE_COLS)


def on_stations(fx: Fixtures, rows: DataFrame) -> DataFrame:
    """``rows`` with their station's columns. Labels are placed, so each has one station; by the left join a query
    that reads none of these columns doesn't join at all."""
    st = ingest.stations(fx).select("station_eoi", *STATION_COLS)
    return rows.join(st, "station_eoi", "left").select(
        "station_eoi", "pollutant", "value", "start_time", *STATION_COLS, *FEATURE_COLS)


def feature_view(fx: Fixtures) -> DataFrame:
    """Each label with the latest station features at or before its hour."""
    return on_stations(fx, matched(fx))


def training_set(fx: Fixtures, min_rows: int = MIN_ROWS, digits: int = 6) -> DataFrame:
    """Q4: feature view, bounded labels (P4), pollutants with enough rows (P14),
    temporal and one-hot features, and the pollutant's own prior."""
    # written once, without the stations' columns: the row gate below counts it and the result reads it again
    fv = fx.shared("feature-view", lambda: R.within_bounds(matched(fx)))
    return _with_features(fx, R.min_rows_per_group(fv, "pollutant", min_rows), digits)


def ungated_rows(fx: Fixtures) -> DataFrame:
    """Q4 before the row gate (P14), not written: for reports that read few columns of it and apply the gate to
    what they write or count themselves."""
    return _with_features(fx, R.within_bounds(matched(fx)))


def _with_features(fx: Fixtures, rows: DataFrame, digits: int = 6) -> DataFrame:
    """Bounded labels with their station's columns, temporal and one-hot features and their prior."""
    fv = on_stations(fx, rows)
    fv = FE.with_temporal(fv, "start_time", digits=digits)
    cats = [c for col, vals in FE.CATEGORIES.items() for c in FE.one_hot(col, vals)]
    return fv.select("*", *cats, FE.prior_for("pollutant").alias("prior"))


def prior_report(fx: Fixtures) -> DataFrame:
    """M9 on the raw prior: rows, stations, RMSE / MAE / R^2 per pollutant."""
    # the report counts the rows of each pollutant itself: no copy of them is written to be counted
    return R.enough_rows(M.report(ungated_rows(fx), ["pollutant"], "value", {"prior": "prior"}), MIN_ROWS, "n")


def with_nearest_other(fx: Fixtures, df: DataFrame) -> DataFrame:
    """Planar km from each row's station to the nearest *other* station with rows
    of the same pollutant. Coordinates come from the station table; only the distinct
    (station, pollutant) pairs of ``df`` are searched, and joined back."""
    seen = df.select("station_eoi", "pollutant").distinct()
    st = seen.join(ingest.stations(fx).select("station_eoi", "lat", "lon"), "station_eoi")
    near = written(nearest_other(st, "planar", group=["pollutant"]), "nearest-other")
    return df.join(sent_if_small(near), ["station_eoi", "pollutant"], "left")


def mae_by_distance(fx: Fixtures) -> DataFrame:
    """AG8: prior MAE per pollutant and distance bin to the nearest other station."""
    rows = written(ungated_rows(fx).select("station_eoi", "pollutant", "value", "prior"), "mae-rows")
    rows = R.min_rows_per_group(rows, "pollutant", MIN_ROWS)
    return M.mae_by_distance(with_nearest_other(fx, rows), ["pollutant"], "value", "dist_km", {"prior": "prior"})


def label_p99(fx: Fixtures) -> DataFrame:
    """AG9: 99th percentile of the bounded label per pollutant (linear interpolation)."""
    ts = training_set(fx)
    return M.exact_quantiles(ts, ["pollutant"], "value", 0.99, "p99").select("pollutant", F.round("p99", 6).alias("p99"))


def density_hex(fx: Fixtures) -> DataFrame:
    """AG10: observed-vs-prior density on a 45-wide hex lattice over [0, p99]^2.

    The per-pollutant extent comes from the p99 aggregate, joined back on pollutant
    (one row per pollutant)."""
    ts = training_set(fx)
    hi = M.exact_quantiles(ts, ["pollutant"], "value", 0.99, "_hi").drop("n")
    j = ts.select("pollutant", "value", "prior").join(F.broadcast(hi), "pollutant")
    return M.hex_bins(j, "value", "prior", (F.lit(0.0), F.col("_hi"), F.lit(0.0), F.col("_hi")), ["pollutant"])


def calibration(fx: Fixtures, q: float = 0.9) -> DataFrame:
    """AG14: prior residual quantile per distance bin from the stations of one half, and its
    coverage on the other half's (halves by a hash of the station code)."""
    rows = written(training_set(fx).select("station_eoi", "pollutant", "value", "prior"), "calibration-rows")
    withd = written(with_nearest_other(fx, rows).withColumn("dist_bin", distance_bin(F.col("dist_km")))
                    .filter(F.col("dist_bin").isNotNull())
                    .withColumns({"abs_err": F.abs(F.col("prior") - F.col("value")),
                                  "half": F.conv(F.substring(F.md5(F.col("station_eoi").cast("binary")), 1, 1), 16, 10).cast("int") % 2}),
                    "calibration-errors")
    return M.calibration(withd.where("half = 0"), withd.where("half = 1"), ["pollutant", "dist_bin"], "abs_err", q)


def error_map(fx: Fixtures, cell_deg: float = 0.25) -> DataFrame:
    """AG16: mean prior error per pollutant and grid cell."""
    ts = training_set(fx)
    return (ts.groupBy("pollutant", snap(F.col("lat"), cell_deg).alias("clat"),
                       snap(F.col("lon"), cell_deg).alias("clon"))
              .agg(F.count(F.lit(1)).alias("n"),
                   F.round(F.avg(F.col("prior") - F.col("value")), 6).alias("mean_err"),
                   F.round(F.avg(F.abs(F.col("prior") - F.col("value"))), 6).alias("mean_abs_err")))
