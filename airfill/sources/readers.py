"""Sources (SC1-SC4, SC7, SC8): explicit schemas, never inference."""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Service variable -> our feature name
WEATHER_VARS = {
    "wind_speed_10m": "wind_speed", "wind_direction_10m": "wind_dir",
    "temperature_2m": "temp", "relative_humidity_2m": "humidity",
    "precipitation": "precip", "surface_pressure": "pressure",
}
PRIOR_VARS = {
    "pm2_5": "cams_pm25", "nitrogen_dioxide": "cams_no2", "ozone": "cams_o3",
    "sulphur_dioxide": "cams_so2", "carbon_monoxide": "cams_co",
    "dust": "cams_dust", "aerosol_optical_depth": "cams_aod",
}
HOUR_FORMAT = "yyyy-MM-dd'T'HH:mm"

READING_COLUMNS = {"Samplingpoint": "string", "Start": "timestamp_ntz", "End": "timestamp_ntz", "Validity": "int"}
STATION_POINTS_COLUMNS = ["Air Quality Station EoI Code", "Air Pollutant", "Longitude", "Latitude",
                          "Altitude", "Air Quality Station Area", "Air Quality Station Type"]


def reading_files(spark: SparkSession, paths: Sequence[str]) -> tuple[dict[str, list[str]], list[tuple[str, str]]]:
    """The files of ``paths`` by the type their ``Value`` is stored with, and the files that
    can't be read with the reason. Only footers are read, on the driver, one per file."""
    kinds: dict[str, list[str]] = {}
    skipped: list[tuple[str, str]] = []
    for path in sorted(paths):
        try:
            schema = spark.read.parquet(path).schema
            missing = [c for c in (*READING_COLUMNS, "Value") if c not in schema.names]
            if missing:
                skipped.append((path, "no column " + ", ".join(missing)))
            else:
                kinds.setdefault(schema["Value"].dataType.simpleString(), []).append(path)
        except (PySparkException, Py4JJavaError) as e:
            skipped.append((path, " ".join(str(e).split())[:300]))
    return kinds, skipped


def read_readings(spark: SparkSession, paths: Sequence[str], pollutant: str | None = None,
                  dataset: int | None = None, row_id: str | None = None) -> tuple[DataFrame, list[tuple[str, str]]]:
    """SC1: many hourly reading files as one DataFrame (U1) in the shape the label operators
    take, and the files left out with the reason (never silently).

    Each file is read with the types it has - a ``Value`` may be text, double or decimal -
    and the number becomes text afterwards. Pollutant and dataset come from the arguments,
    from columns (or partition folders) of that name, or from ``<dataset>/<pollutant>/`` in the path; ``row_id`` is the stored column of that
    name argument, or the row's place in its file."""
    def told(raw: DataFrame, name: str, given, place):
        return (F.lit(given) if given is not None else F.col(name) if name in raw.columns else place).alias(name)

    kinds, skipped = reading_files(spark, paths)
    out = None
    for files in kinds.values():
        raw = spark.read.parquet(*files)
        place = F.split(F.col("_metadata.file_path"), "/")
        part = raw.select(
            *[F.col(c).cast(t).alias(c) for c, t in READING_COLUMNS.items()],
            F.col("Value").cast("string").alias("value_text"),
            told(raw, "pollutant", pollutant, F.element_at(place, -2)),
            told(raw, "dataset", dataset, F.element_at(place, -3).try_cast("int")).cast("int").alias("dataset"),
            (F.col(row_id) if row_id else F.col("_metadata.row_index")).cast("long").alias("row_id"))
        part = part.select(F.col("Samplingpoint").alias("samplingpoint"), "pollutant", "dataset", "row_id",
                           F.col("Start").alias("start_time"), F.col("End").alias("end_time"), "value_text",
                           F.col("Validity").alias("validity"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], "samplingpoint string, pollutant string, dataset int, row_id long, "
                                        "start_time timestamp_ntz, end_time timestamp_ntz, value_text string, validity int")
    return out, skipped


def read_station_points(spark: SparkSession, path: str) -> DataFrame:
    """SC2: station metadata CSV, every column as text (numbers are parsed later by
    ``to_number``), renamed to the station-point columns."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in STATION_POINTS_COLUMNS])
    df = spark.read.schema(schema).option("header", True).csv(path)
    names = ["station_eoi", "air_pollutant", "lon_text", "lat_text", "altitude_text",
             "station_area", "station_type"]
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(STATION_POINTS_COLUMNS, names)])


def explode_hourly(df: DataFrame, json_col: str, rename: dict[str, str],
                   keep: Sequence[str] = (), elevation: str | None = "altitude",
                   place: str | None = None) -> DataFrame:
    """SC3 / SC4: an hourly JSON payload (``{"elevation":..,"hourly":{"time":[..],
    "<var>":[..]}}``; with ``place`` a list of them) -> one row per hour with the variables renamed. A short array
    or a JSON null gives NULL (``get`` is NULL out of range); numbers are doubles."""
    hourly = T.StructType([T.StructField("time", T.ArrayType(T.StringType()))] +
                          [T.StructField(src, T.ArrayType(T.DoubleType())) for src in rename])
    schema = T.StructType([T.StructField("elevation", T.DoubleType()),
                           T.StructField("hourly", hourly)])
    if place:  # a list of responses, or one by itself: each with its number in ``place``
        text = F.trim(F.col(json_col))
        listed = F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
        parsed = df.select(*keep, F.posexplode(F.from_json(listed, T.ArrayType(schema))).alias(place, "_p"))
        keep = [*keep, place]
    else:
        parsed = df.select(*keep, F.from_json(F.col(json_col), schema).alias("_p"))
    rows = parsed.select(*keep, F.col("_p.elevation").alias("_elev"), F.col("_p.hourly").alias("_h"),
                         F.posexplode_outer("_p.hourly.time").alias("_i", "_t"))
    out = [*keep]
    if elevation:
        out.append(F.col("_elev").alias(elevation))
    out.append(F.to_timestamp_ntz(F.col("_t"), F.lit(HOUR_FORMAT)).alias("valid_time"))
    out += [F.get(F.col(f"_h.{src}"), F.col("_i")).alias(dst) for src, dst in rename.items()]
    return rows.filter(F.col("_t").isNotNull()).select(*out)


def dimension(spark: SparkSession, rows: dict[str, str], key: str, value: str) -> DataFrame:
    """SC8: a small code -> name dimension table (vocabularies, country codes)."""
    return spark.createDataFrame(sorted(rows.items()), [key, value])
