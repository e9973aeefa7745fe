"""Static context, stored series and the extended features (J2, J15, J17, J18, AG17, M2, F5, P12, T-2, T-3,
SC2, SC4, SC8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airfill.functions.display import distance_bin
from airfill.functions.geo import snap
from airfill.functions.temporal import wind_vector
from airfill.operators import features as FE
from airfill.operators import readings as R
from airfill.operators import spatial as S
from airfill.plans import field as FLD
from airfill.plans import ingest, satellite, training
from airfill.session import scratch_path, written
from airfill.sources import readers
from airfill.sources.fixtures import Fixtures
from airfill.sources.sinks import bucketed

# Fixed values
SAMPLE_N, SEED = 20, "42"
SERIES_BUCKETS = 16


def places(fx: Fixtures) -> DataFrame:
    """The places table, written once for the parts of a query that read it."""
    return fx.shared("places", lambda: fx.table("places"))


def cell_context(fx: Fixtures) -> DataFrame:
    """The context table: per weather cell the people in it, its commonest land cover (ties: by name), road length
    and mean elevation. Cover is counted per cell and kind first, so that no cell's places meet in one row."""
    cell = [snap(F.col("lat"), ingest.CELL_DEG).alias("clat"), snap(F.col("lon"), ingest.CELL_DEG).alias("clon")]
    kinds = places(fx).groupBy(*cell, "land_cover").agg(
        F.count(F.lit(1)).alias("n"), F.sum("persons").alias("persons"), F.sum("road_km").alias("road_km"),
        F.sum("elevation").alias("elevation"))
    return kinds.groupBy("clat", "clon").agg(
        F.sum("persons").alias("population"), F.sum("road_km").alias("road_km"),
        F.min_by("land_cover", F.struct(-F.col("n"), F.col("land_cover"))).alias("land_cover"),
        F.round(F.sum("elevation") / F.sum("n"), 4).alias("elevation"))


def station_context(fx: Fixtures) -> DataFrame:
    """J17 + J18: every station with the context of its cell, where there is any, and the great-circle km to
    the nearest point source. The stations' side is as small as the context is large; the
    context is joined on the cell's key and broadcast only if Spark sees that it is small."""
    st = ingest.stations(fx).select("station_eoi", "lat", "lon", snap(F.col("lat"), ingest.CELL_DEG).alias("clat"),
                                    snap(F.col("lon"), ingest.CELL_DEG).alias("clon"))
    context = fx.shared("cell-context", lambda: cell_context(fx))
    sources = places(fx).where(F.col("land_cover") == "MACHINERY").select(
        F.col("place_id").alias("source"), F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"))
    near = S.knn(st.select("station_eoi", "lat", "lon"), sources, 1, ["station_eoi"], "source", metric="haversine")
    return (st.join(context, ["clat", "clon"], "left")
              .join(near.select("station_eoi", F.round("dist_km", 6).alias("dist_point_source")), "station_eoi", "left")
              .select("station_eoi", "clat", "clon", "population", "road_km", "land_cover", "elevation", "dist_point_source"))


def population_by_distance(fx: Fixtures) -> DataFrame:
    """AG17: people by the distance of where they live to the nearest station, and their share."""
    st = FLD.field_stations(fx).select(F.col("station_eoi").alias("site"), F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"))
    near = S.knn(places(fx).select("place_id", "lat", "lon"), st, 1, ["place_id"], "site", metric="haversine")
    people = places(fx).select("place_id", "persons").join(near.select("place_id", "dist_km"), "place_id")
    # the first bin is closed at zero here: one may live at a station
    bins = written(people.withColumn("dist_bin", distance_bin(F.greatest(F.col("dist_km"), F.lit(1e-9))))
                   .groupBy("dist_bin").agg(F.count(F.lit(1)).alias("places"), F.sum("persons").alias("persons")), "people")
    total = bins.agg(F.sum("persons").alias("total"))
    return bins.join(F.broadcast(total)).select(  # one row
        "dist_bin", "places", "persons", F.round(F.col("persons") / F.col("total"), 6).alias("share"))


def stored_series(fx: Fixtures) -> tuple[DataFrame, DataFrame]:
    """The weather and the prior series as tables bucketed and sorted by cell and hour."""
    made = []
    for name, view in (("weather", fx.weather_series), ("prior", fx.prior_series)):
        keyed = view.withColumn("cell_id", FLD.cell_id()).drop("clat", "clon")
        made.append(bucketed(keyed, f"{name}_series", scratch_path(fx.spark, f"{name}-series"), ["cell_id", "valid_time"], SERIES_BUCKETS))
    return made[0], made[1]


def joined_series(weather: DataFrame, prior: DataFrame) -> DataFrame:
    """Weather beside the prior of the same cell and hour. Both sides lie in the same buckets, so
    that neither is shuffled or sorted again."""
    return weather.join(prior.hint("merge"), ["cell_id", "valid_time"])


def cell_series(fx: Fixtures) -> DataFrame:
    """J2 over the stored series, rounded as stored features are."""
    return joined_series(*stored_series(fx)).select("cell_id", "valid_time", "temp", "wind_dir", "cams_no2", "cams_pm25")


def station_sample(fx: Fixtures, n: int = SAMPLE_N, seed: str = SEED) -> DataFrame:
    """P12 + T-2: ``n`` stations drawn by a seed, in order of their code."""
    return R.sampled(ingest.stations(fx).select("station_eoi", "lat", "lon"), "station_eoi", n, seed).orderBy("station_eoi")


def first_stations(fx: Fixtures, n: int = SAMPLE_N) -> DataFrame:
    """T-3: a cap on stations, the first by code."""
    return ingest.stations(fx).select("station_eoi", "lat", "lon").orderBy("station_eoi").limit(n)


def extended_features(fx: Fixtures) -> DataFrame:
    """M2 + F5 + J15: every training row with the wind as a vector, the satellite's columns of its day and its
    station's context; a row without them keeps its place with nulls."""
    ts = training.training_set(fx).select("station_eoi", "pollutant", "start_time", "value", "prior", "temp", "wind_dir")
    sat = satellite.stored_daily(fx).select("station_eoi", F.col("obs_date").alias("day"), *FE.SATELLITE)
    sin, cos = wind_vector(F.col("wind_dir"))
    rows = ts.withColumns({"day": F.date_trunc("DAY", "start_time").cast("timestamp_ntz"),
                           "wind_dir_sin": F.round(sin, 6) + F.lit(0.0), "wind_dir_cos": F.round(cos, 6) + F.lit(0.0)})
    # written as well: while its size is unknown, the rows are shuffled and sorted once more for it
    context = fx.shared("station-contexts", lambda: station_context(fx).select(
        "station_eoi", "population", "land_cover", "road_km", "elevation", "dist_point_source"))
    return (rows.join(sat, ["station_eoi", "day"], "left").join(context, "station_eoi", "left")
                .select("station_eoi", "pollutant", "start_time", "value", "prior", "temp", "wind_dir_sin", "wind_dir_cos", *FE.SATELLITE,
                        "population", "land_cover", "road_km", "elevation", "dist_point_source"))


def station_file(fx: Fixtures) -> DataFrame:
    """SC2 + SC8: station metadata delivered as a CSV file of text columns, read back, placed, and named by the
    dimension of countries."""
    path = scratch_path(fx.spark, "station-csv")
    cols = ["station_eoi", "air_pollutant", "lon_text", "lat_text", "altitude_text", "station_area", "station_type"]
    names = dict(zip(cols, readers.STATION_POINTS_COLUMNS, strict=True))
    fx.station_points.select(*[F.col(c).alias(n) for c, n in names.items()]).write.option("header", True).csv(path)
    meta = R.station_metadata(readers.read_station_points(fx.spark, path), ("NO2", "PM2.5"))
    countries = readers.dimension(fx.spark, ingest.COUNTRY_NAMES, "country", "country_name")
    return (meta.withColumn("country", F.substring("station_eoi", 1, 2)).join(F.broadcast(countries), "country", "left")
                .select("station_eoi", "lat", "lon", "altitude", "station_area", "station_type", "country", "country_name"))


def hourly_lists(fx: Fixtures) -> DataFrame:
    """SC4: responses for several places in one list, and single ones, as rows per place and hour."""
    listed = fx.hourly_payloads.groupBy((F.col("station_no") - F.col("station_no") % 3).alias("request")).agg(
        F.concat(F.lit("["), F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("station_no", "payload"))),
                                                           lambda x: x["payload"])), F.lit("]")).alias("payload"))
    single = fx.hourly_payloads.select((-F.col("station_no") - 1).alias("request"), "payload")
    return readers.explode_hourly(listed.unionByName(single), "payload", {"pm2_5": "cams_pm25", "nitrogen_dioxide": "cams_no2"},
                                  keep=["request"], place="place")
