"""Daily satellite columns per station (Q3: SC5, SC6, P8-P10, J6, J9, AG3, AG5, J7)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airfill.operators import spatial as S
from airfill.plans import ingest
from airfill.sources.fixtures import Fixtures

# Fixed values
# product -> (output column, minimum qa)
PRODUCTS = {
    "L2__NO2___": ("no2_column", 0.75),
    "L2__AER_AI": ("aerosol_index", 0.50),
}
MAX_PIXEL_KM = 8.0
DAYTIME_HOURS = (8, 14)
STREAM = "OFFL"
GRANULE_STAMP = r"(\d{8}T\d{2})"


def clean_pixels(pixels: DataFrame, fill_value: float | None = None, qa_scale: float | None = None) -> DataFrame:
    """SC5: fill value -> NULL, scaled qa -> fraction."""
    v = F.col("value")
    if fill_value is not None:
        v = F.when(v == F.lit(fill_value), F.lit(None)).otherwise(v)
    # rounded so that 75 hundredths meet a bound of 0.75
    qa = F.col("qa") if qa_scale is None else F.round(F.col("qa") * F.lit(qa_scale), 6)
    return pixels.withColumns({"value": v, "qa": qa})


def good_pixels(pixels: DataFrame) -> DataFrame:
    """Finite value and qa at least the product's minimum."""
    qmin = None
    for prod, (_, q) in PRODUCTS.items():
        qmin = (F.when(F.col("product") == prod, F.lit(q)) if qmin is None
                else qmin.when(F.col("product") == prod, F.lit(q)))
    v = F.col("value")
    return pixels.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
                         & (F.col("qa") >= qmin))


def daytime(granules: DataFrame) -> DataFrame:
    """P10: granules whose name stamp hour is within 08..14 UTC."""
    stamp = F.regexp_extract(F.col("name"), GRANULE_STAMP, 1)
    hour = F.substring(stamp, -2, 2).try_cast("int")
    lo, hi = DAYTIME_HOURS
    return granules.filter(hour.between(lo, hi))


def search_granules(granules: DataFrame, boxes: DataFrame, products: Sequence[str] = tuple(PRODUCTS),
                    day: str | None = None) -> DataFrame:
    """SC6 + J9: daytime offline granules of ``products`` (of one ``day``, if given) intersecting
    any search box, once per name. The catalogue is filtered before the tile join."""
    wanted = F.lit(False)
    for p in products:
        wanted = wanted | F.col("name").contains(p)
    g = daytime(granules).where(F.col("name").contains(STREAM) & wanted)
    if day:
        start = F.lit(day).cast("timestamp_ntz")
        g = g.where((F.col("sensed_at") >= start) & (F.col("sensed_at") < start + F.expr("INTERVAL 1 DAY")))
    hits = S.boxes_overlap(g, boxes)
    return hits.select("granule", "product", "sensed_at", "name").dropDuplicates(["name"])


#: Stored fill value and scale of a product file (P9 follows on the unpacked values).
FILL, QA_SCALE = 9.96921e36, 0.01


def packed_pixels(fx: Fixtures) -> DataFrame:
    """SC5 + P9: pixels as product files store them - quality as whole hundredths, missing values
    as a fill value - unpacked and filtered."""
    stored = fx.pixels.withColumns({"qa": F.round(F.col("qa") * 100).cast("int"), "value": F.coalesce("value", F.lit(FILL))})
    return good_pixels(clean_pixels(stored, FILL, QA_SCALE)).select(
        "granule", "product", "pixel_id", F.round("qa", 2).alias("qa"), F.round("value", 12).alias("value"))


def station_boxes(fx: Fixtures) -> DataFrame:
    """AG5 over the placed stations."""
    return S.station_boxes(ingest.stations(fx))


def nearest_pixels(fx: Fixtures, granule_filter: bool = True) -> DataFrame:
    """Per station and granule, the nearest good pixel within 8 km (chord test on
    the unit sphere; ties to the lowest pixel id)."""
    st = ingest.stations(fx).select("station_eoi", "lat", "lon")
    px = good_pixels(clean_pixels(fx.pixels))
    if granule_filter:
        g = search_granules(fx.granules, station_boxes(fx)).select("granule")
        px = px.join(g, "granule", "left_semi")
    sites = px.select("pixel_id", "granule", "product", "value",
                      F.date_trunc("DAY", F.col("sensed_at")).cast("timestamp_ntz").alias("obs_date"),
                      F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"))
    return S.nearest_within(st, sites, MAX_PIXEL_KM, ["station_eoi"], "pixel_id",
                            by=["granule", "product", "obs_date"], metric="chord", carry=["value"])


def satellite_daily(fx: Fixtures, digits: int = 12) -> DataFrame:
    """Q3: one row per station and day with at least one product value (P8), means
    over the day's overpasses (AG3), products side by side (J7)."""
    hits = nearest_pixels(fx)
    means = hits.groupBy("station_eoi", "obs_date", "product").agg(F.avg("value").alias("v"))
    wide = (means.groupBy("station_eoi", "obs_date")
                 .pivot("product", list(PRODUCTS))
                 .agg(F.first("v")))
    for prod, (col, _) in PRODUCTS.items():
        wide = wide.withColumnRenamed(prod, col)
    st = ingest.stations(fx).select("station_eoi", "lat", "lon")
    out = wide.join(st, "station_eoi", "inner").na.drop("all", subset=[c for c, _ in PRODUCTS.values()])
    return out.select("station_eoi", "obs_date", "lat", "lon",
                      *[F.round(c, digits).alias(c) for c, _ in PRODUCTS.values()])


def stored_daily(fx: Fixtures) -> DataFrame:
    """Q3 written, for a join with the training rows: that it is small is then known before they are shuffled."""
    return fx.shared("satellite-days", lambda: satellite_daily(fx))


def granules_of_a_day(fx: Fixtures) -> DataFrame:
    """SC6 for one product and day of the catalogue."""
    return search_granules(fx.granules, station_boxes(fx), ("L2__NO2___",), "2024-01-03")


def granule_footprints(fx: Fixtures, zoom: int = 6) -> DataFrame:
    """F22 + F19: searched granules with their box as WKT text and the map tile (at
    ``zoom``) of the box centre."""
    from airfill.functions import geo
    g = fx.granules
    found = search_granules(g, station_boxes(fx)).select("granule")
    g = g.join(found, "granule", "left_semi")
    cx = (F.col("lon0") + F.col("lon1")) / 2
    cy = (F.col("lat0") + F.col("lat1")) / 2
    tx, ty = geo.tile_xy(cy, cx, zoom)
    return g.select("granule", "name", geo.box_wkt("lon0", "lat0", "lon1", "lat1").alias("wkt"),
                    tx.alias("tile_x"), ty.alias("tile_y"))
