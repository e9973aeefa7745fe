"""The continental field and its readers (Q6, Q7, Q8, Q10; J8, J10, J13, J14, W4, F12-F18).

The field is a long table (grid point x hour x pollutant) rather than per-hour frames, and
holds every point and hour of the window, without a value where the priors are missing.
Conditions come from the nearest 0.25-degree weather cell (exact nearest search, then an
equi join on cell and hour). The value is the newest registered model's, or the
pollutant's prior without one. The distance to the nearest station is computed once per
grid point (F9 metric), never per hour.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airfill.functions import display as D
from airfill.functions import geo
from airfill.functions import temporal as TM
from airfill.functions import text as TX
from airfill.operators import features as FE
from airfill.operators import model as MD
from airfill.operators import readings as R
from airfill.operators import spatial as S
from airfill.plans import ingest
from airfill.plans.ingest import cell_id
from airfill.session import checkpoint
from airfill.sources.fixtures import Fixtures

# Fixed values
WINDOW_H = 12
HOTSPOT_KM = 25.0
HOTSPOT_N = 6
NEAREST_N = 3
POLLUTANTS = ("pm25", "no2")


def field_stations(fx: Fixtures) -> DataFrame:
    """Stations shown on the map: NO2 / PM2.5 stations of the theatre countries."""
    return R.in_countries(ingest.stations(fx), ingest.COUNTRIES)


def grid_distance(fx: Fixtures) -> DataFrame:
    """Km from each grid point to the nearest station (F9), rounded to 0.1."""
    spark = fx.spark
    grid = S.grid_points(spark)
    st = field_stations(fx).select(F.col("station_eoi").alias("site"),
                                   F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"))
    nn = S.knn(grid, st, 1, ["row", "col"], "site", metric="equirect_point")
    return (grid.join(nn.select("row", "col", "dist_km"), ["row", "col"], "left")
                .select("row", "col", "lat", "lon", F.round("dist_km", 1).alias("dist_km")))


def hours_around(fx: Fixtures, now: str | None = None) -> DataFrame:
    """One row (first_hour, last_hour, now) of the window of +-12 h on the hourly axis of the
    weather table. A ``now`` off the axis, or none, is the axis' middle hour."""
    given = F.lit(now).cast("timestamp_ntz")
    axis = fx.cell_weather.agg(F.min("valid_time").alias("lo"), F.max("valid_time").alias("hi"))
    n = F.timestamp_diff("HOUR", F.col("lo"), F.col("hi")) + 1
    hour = F.timestamp_diff("HOUR", F.col("lo"), F.date_trunc("HOUR", given).cast("timestamp_ntz"))
    axis = axis.withColumns({"n": n}).withColumn("c", F.coalesce(
        F.when((hour >= 0) & (hour < F.col("n")), hour), F.floor(F.col("n") / 2)).cast("long"))

    def at(i):
        return F.timestamp_add("HOUR", i.cast("int"), F.col("lo"))

    return axis.where(F.col("lo").isNotNull()).select(
        at(F.greatest(F.lit(0), F.col("c") - WINDOW_H)).alias("first_hour"),
        at(F.least(F.col("n") - 1, F.col("c") + WINDOW_H)).alias("last_hour"), at(F.col("c")).alias("now"))


def field_axis(fx: Fixtures) -> DataFrame:
    """W4 + W5 + F21: the hours of the window, as text, with their offset from "now"."""
    w = hours_around(fx).withColumn("valid_time", F.explode(F.sequence("first_hour", "last_hour", F.expr("INTERVAL 1 HOUR"))))
    return w.select("valid_time", TM.iso_hour("valid_time").alias("iso"),
                    TM.hour_offset("now", "valid_time").alias("offset_h"))


def grid_with_cells(fx: Fixtures) -> DataFrame:
    """Every grid point with its weather cell: the one with the nearest centre (great circle; ties
    to the lower cell id)."""
    cells = fx.cell_weather.select(cell_id().alias("cell_id"), F.col("clat").alias("s_lat"), F.col("clon").alias("s_lon")).distinct()
    grid = S.grid_points(fx.spark)
    near = S.knn(grid, cells, 1, ["row", "col"], "cell_id", metric="haversine").select("row", "col", "cell_id")
    return grid.join(near, ["row", "col"], "left")


def conditions(fx: Fixtures, now: str | None = None, now_only: bool = False) -> DataFrame:
    """J14 + W4: conditions of every grid point at every hour of the window, or at "now" only; NULL
    where its weather cell has no row for the hour."""
    cw = fx.cell_weather.withColumn("cell_id", cell_id())
    # the window's bounds are scalar subqueries: no join, and they reach the scan as filters
    w = hours_around(fx, now)
    if now_only:
        w = w.select(F.col("now").alias("first_hour"), F.col("now").alias("last_hour"), "now")
    hourly = fx.spark.sql("SELECT *, explode(sequence((SELECT first_hour FROM {w}), (SELECT last_hour FROM {w}), "
                          "INTERVAL 1 HOUR)) AS valid_time FROM {g}", w=w, g=grid_with_cells(fx))
    recent = fx.spark.sql("SELECT * FROM {c} WHERE valid_time BETWEEN (SELECT first_hour FROM {w}) "
                          "AND (SELECT last_hour FROM {w})", w=w, c=cw)
    return hourly.join(recent.drop("clat", "clon"), ["cell_id", "valid_time"], "left").drop("cell_id")


def predicted(cond: DataFrame, pollutant: str, model: PipelineModel | None) -> DataFrame:
    """M8: ``cond`` with ``value``: the model's estimate for a neutral station (no local
    source) at each point, or the prior without a model; clamped at 0, one decimal, NULL
    where either prior is missing (P16 / T9)."""
    ok = F.col("cams_pm25").isNotNull() & F.col("cams_no2").isNotNull()
    prior = FE.PRIOR_OF[pollutant]
    df = cond
    if model is not None:
        df = FE.with_temporal(df, "valid_time", digits=6).withColumns({
            "altitude": F.lit(0.0), "altitude_missing": F.lit(0.0),
            **{f"{c}_{v}": F.lit(float(FE.NEUTRAL[c] == v)) for c, vs in FE.CATEGORIES.items() for v in vs}})
    scored = MD.score(df, model, prior)
    return scored.select(*cond.columns, F.lit(pollutant).alias("pollutant"), F.col(prior).alias("prior"),
                         F.when(ok, F.round(D.clamp0(F.col("prediction")), 1)).alias("value"))


def full_field(fx: Fixtures, models: dict[str, PipelineModel] | None = None, now: str | None = None,
               now_only: bool = False) -> DataFrame:
    """Every grid point x hour x pollutant with its conditions, value, prior, distance, trust
    class and status. ``status`` is "model" as soon as any pollutant has a model."""
    cond = conditions(fx, now, now_only)
    if models:  # read once per pollutant by the model stages
        cond = checkpoint(cond)
    parts = [predicted(cond, p, (models or {}).get(p)) for p in POLLUTANTS]
    dist = grid_distance(fx).select("row", "col", "dist_km")
    return (parts[0].unionByName(parts[1]).join(dist, ["row", "col"], "left")
            .withColumns({"trust": D.trust_class(F.col("dist_km")),
                          "status": F.lit("model" if models else "cams-prior")}))


FIELD_COLUMNS = ["row", "col", "lat", "lon", "valid_time", "pollutant", "value", "dist_km", "trust", "status"]


def field(fx: Fixtures, models: dict[str, PipelineModel] | None = None, now: str | None = None) -> DataFrame:
    """Q6: the whole grid x window x pollutants."""
    return full_field(fx, models, now).select(*FIELD_COLUMNS)


def now_frame(fx: Fixtures, models: dict[str, PipelineModel] | None = None, now: str | None = None) -> DataFrame:
    """The field at "now": the other hours are never built."""
    return full_field(fx, models, now, now_only=True)


def hotspots(fx: Fixtures, n: int = HOTSPOT_N, models: dict[str, PipelineModel] | None = None) -> DataFrame:
    """Q7 / T-1: per pollutant the ``n`` highest values farther than 25 km from any
    station (ties: lat, lon), with the sentence of F24. ``row_number <= n`` is planned
    with a partial per-partition limit before the shuffle."""
    f = now_frame(fx, models).filter(F.col("value").isNotNull() & (F.col("dist_km") > HOTSPOT_KM))
    w = Window.partitionBy("pollutant").orderBy(F.col("value").desc(), "lat", "lon")
    top = f.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return top.select("pollutant", "rank", "lat", "lon", "value", "dist_km",
                      TX.hotspot_sentence(F.col("value"), F.col("lat"), F.col("lon"),
                                          F.col("dist_km")).alias("text"))


def point_report(fx: Fixtures, models: dict[str, PipelineModel] | None = None) -> DataFrame:
    """Q8: the point report for every grid point in the theatre (P11) that has both
    priors now: values, priors, three nearest stations (J8, F8 metric), weather and reasons."""
    f = now_frame(fx, models).filter(geo.in_theatre(F.col("lat"), F.col("lon")) & F.col("value").isNotNull())
    wide = (f.groupBy("row", "col", "lat", "lon", "temp", "wind_dir")
             .pivot("pollutant", list(POLLUTANTS))
             .agg(F.first("value").alias("value"), F.first(F.round(F.col("prior"), 1)).alias("prior")))
    wide = checkpoint(wide)
    return _reported(fx, wide, ["row", "col"], bool(models)).select("lat", "lon", *REPORT_COLUMNS)


REPORT_COLUMNS = ["pm25_value", "pm25_prior", "no2_value", "no2_prior", "temp", "wind_dir", "nearest", "reasons"]


def _reported(fx: Fixtures, wide: DataFrame, key: list[str], modelled: bool) -> DataFrame:
    """``wide`` (key, lat, lon, values, priors, weather) with the three nearest stations and the reasons."""
    st = field_stations(fx).select(F.col("station_eoi").alias("site"),
                                   F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"))
    nn = S.knn(wide.select(*key, "lat", "lon"), st, NEAREST_N, key, "site",
               metric="equirect_mean")
    near = (nn.groupBy(*key)
              .agg(F.sort_array(F.collect_list(F.struct("rank", "site", F.round("dist_km", 1).alias("d"))))
                   .alias("_n")))
    j = wide.join(near, key, "left")
    first = F.get(F.col("_n"), F.lit(0))
    reasons = TX.reasons(F.lit(modelled), F.col("pm25_value"), F.col("pm25_prior"), F.col("no2_value"),
                         F.col("no2_prior"), first["site"], first["d"])
    return j.select(
        *key, "lat", "lon", "pm25_value", "pm25_prior", "no2_value", "no2_prior",
        F.round("temp", 1).alias("temp"), F.round("wind_dir", 1).alias("wind_dir"),
        F.concat_ws(",", F.transform("_n", lambda x: F.format_string("%s:%.1f", x["site"], x["d"])))
         .alias("nearest"),
        F.concat_ws("; ", reasons).alias("reasons"))


def place_report(fx: Fixtures, places: DataFrame, key: str, models: dict[str, PipelineModel] | None = None,
                 now: str | None = None) -> DataFrame:
    """Q8 over a table of places (a unique ``key``, lat, lon): one row per place with the point report
    of its own nearest weather cell at "now", or with ``error`` and nothing else where it lies outside the
    theatre (or nowhere: a null coordinate) or has no PM2.5 prior."""
    inside = places.select(key, "lat", "lon").where(geo.in_theatre(F.col("lat"), F.col("lon")))
    cw = fx.cell_weather.withColumn("cell_id", cell_id())
    cells = cw.select("cell_id", F.col("clat").alias("s_lat"), F.col("clon").alias("s_lon")).distinct()
    near = S.knn(inside, cells, 1, [key], "cell_id", metric="haversine").select(key, "cell_id")
    # one row per cell at one hour, read beforehand: a constant reaches the scan, and a broadcast can't meet it unfinished
    hour = hours_around(fx, now).first()
    weather = cw.drop("clat", "clon").where(F.col("valid_time") == F.lit(hour and hour["now"]).cast("timestamp_ntz"))
    cond = checkpoint(inside.join(near, key).join(weather, "cell_id").where(F.col("cams_pm25").isNotNull()).drop("cell_id"))
    wide = cond.select(key, "lat", "lon", "temp", "wind_dir")
    for p in POLLUTANTS:
        own = predicted(cond, p, (models or {}).get(p)).select(
            key, F.col("value").alias(f"{p}_value"), F.round("prior", 1).alias(f"{p}_prior"))
        wide = wide.join(own, key)
    found = _reported(fx, checkpoint(wide), [key], bool(models)).drop("lat", "lon")
    error = (F.when(~F.coalesce(geo.in_theatre(F.col("lat"), F.col("lon")), F.lit(False)), "out of theatre")
              .when(F.col("reasons").isNull(), "no CAMS data here"))
    return places.select(key, "lat", "lon").join(found, key, "left").select(
        key, "lat", "lon", error.alias("error"), *REPORT_COLUMNS)


def mosaic(fx: Fixtures, models: dict[str, PipelineModel] | None = None) -> DataFrame:
    """Q10: display points (satellite pixel centres) -> nearest grid cell by rounding
    (J13) -> colour by trust ramp (F18) and opacity by value and distance (F17), for each
    pollutant."""
    f = now_frame(fx, models).filter(F.col("value").isNotNull())
    ir, ic = S.grid_cell_of(F.col("lat"), F.col("lon"))
    pts = fx.pixels.select("pixel_id", ir.alias("row"), ic.alias("col")).filter(F.col("row").isNotNull())
    j = pts.join(f.select("row", "col", "pollutant", "value", "dist_km"), ["row", "col"], "inner")
    most = F.when(F.col("pollutant") == "pm25", F.lit(D.VMAX["pm25"])).otherwise(F.lit(D.VMAX["no2"]))
    t = F.least(F.lit(1.0), F.col("value") / most)
    colour = F.when(F.col("dist_km") <= D.VERIFIED_KM, D.ramp(t, D.MEAS_STOPS)).otherwise(D.ramp(t, D.PRED_STOPS))
    return j.select("pixel_id", "row", "col", "pollutant", "value", "dist_km",
                    colour.alias("_c"), F.round(D.opacity(t, F.col("dist_km")), 4).alias("alpha")) \
            .select("pixel_id", "row", "col", "pollutant", "value", "dist_km",
                    F.col("_c.r").alias("r"), F.col("_c.g").alias("g"), F.col("_c.b").alias("b"), "alpha")
