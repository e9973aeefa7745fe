"""Plan shapes (no nested-loop or cartesian joins in the hand-planned operators) and
sink properties (upsert twice = upsert once)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from airfill.operators import spatial as S
from airfill.operators.asof import asof_join
from airfill.operators.model import latest_models, save_model
from airfill.operators.readings import label_table
from airfill.session import scratch_path, shared_folder
from airfill.sources.readers import read_readings
from airfill.sources.sinks import only_new, upsert
from airfill.sources.fixtures import Fixtures
from airfill.plans import field
from airfill.session import written

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_asof_plan_has_no_nested_loop(spark):
    left = spark.range(100).select(F.col("id").cast("string").alias("k"),
                                   F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("t"))
    right = spark.range(100).select(F.col("id").cast("string").alias("k"),
                                    F.timestamp_seconds(F.col("id") * 30).cast("timestamp_ntz").alias("vt"),
                                    F.col("id").cast("double").alias("x"))
    p = plan_of(asof_join(left, right, "k", "t", "vt"))
    assert "NestedLoop" not in p and "Cartesian" not in p


def test_radius_nearest_plan_is_an_equi_join(spark):
    st = spark.range(50).select(F.col("id").alias("station_eoi"), (F.col("id") / 10 + 40).alias("lat"),
                                (F.col("id") / 10).alias("lon"))
    px = spark.range(500).select(F.col("id").alias("pixel_id"), (F.col("id") / 100 + 40).alias("s_lat"),
                                 (F.col("id") / 100).alias("s_lon"))
    p = plan_of(S.nearest_within(st, px, 8.0, ["station_eoi"], "pixel_id"))
    assert "NestedLoop" not in p and "Cartesian" not in p


def test_upsert_twice_equals_once(spark):
    path = scratch_path(spark, "t-upsert")
    rows = [("a", dt.date(2024, 1, 1), 1, 5.0), ("b", dt.date(2024, 1, 1), 1, 6.0), ("c", dt.date(2024, 1, 2), 1, 7.0)]
    df = spark.createDataFrame(rows, "k string, day date, v int, x double")
    upsert(df, path + "/t", ["k"], [F.col("v")], "day")
    once = sorted(tuple(r) for r in spark.read.parquet(path + "/t").select("k", "v", "x").collect())
    upsert(df, path + "/t", ["k"], [F.col("v")], "day")
    twice = sorted(tuple(r) for r in spark.read.parquet(path + "/t").select("k", "v", "x").collect())
    assert once == twice == [("a", 1, 5.0), ("b", 1, 6.0), ("c", 1, 7.0)]
    newer = spark.createDataFrame([("a", dt.date(2024, 1, 1), 2, 9.0)], df.schema)
    upsert(newer, path + "/t", ["k"], [F.col("v")], "day")
    got = sorted(tuple(r) for r in spark.read.parquet(path + "/t").select("k", "v", "x").collect())
    assert got == [("a", 2, 9.0), ("b", 1, 6.0), ("c", 1, 7.0)]


def test_upsert_refuses_a_key_that_moves(spark):
    path = scratch_path(spark, "t-moves") + "/t"
    schema = "k string, day string, v int"
    upsert(spark.createDataFrame([("a", "2024-01-01", 1), ("b", "2024-01-02", 1)], schema), path, ["k"], [F.col("v")], "day")
    with pytest.raises(ValueError):
        upsert(spark.createDataFrame([("a", "2024-01-03", 2)], schema), path, ["k"], [F.col("v")], "day")
    got = spark.read.schema(schema).parquet(path).collect()
    assert sorted((r["k"], r["day"], r["v"]) for r in got) == [("a", "2024-01-01", 1), ("b", "2024-01-02", 1)]


def test_upsert_splits_a_large_partition(spark):
    path = scratch_path(spark, "t-large") + "/t"
    df = spark.range(1000).selectExpr("id k", "cast(id % 10 == 0 as int) p", "id v")
    upsert(df, path, ["k", "p"], [F.col("v")], "p", file_rows=100)
    upsert(df, path, ["k", "p"], [F.col("v")], "p", file_rows=100)
    files = spark.read.parquet(path).where("p = 0").select(F.input_file_name().alias("f")).distinct().count()
    assert spark.read.parquet(path).count() == 1000 and files > 4


def test_readings_of_every_stored_type(spark):
    root = scratch_path(spark, "t-readings")
    rows = [("LU/SPO-LU0104A_00008_100", dt.datetime(2024, 1, 1, h), dt.datetime(2024, 1, 1, h, 30), str(h) + ".5", 1)
            for h in range(3)]
    df = spark.createDataFrame(rows, "Samplingpoint string, Start timestamp_ntz, End timestamp_ntz, Value string, Validity int")
    for k, t in enumerate(("string", "double", "decimal(10,1)")):
        df.where(F.hour("Start") == k).withColumn("Value", F.col("Value").cast(t)).write.parquet(f"{root}/2/no2/f{k}")
    spark.range(3).selectExpr("'x' || id value").write.text(f"{root}/2/no2/broken")
    spark.range(3).write.parquet(f"{root}/2/no2/other")
    paths = [f"{root}/2/no2/{n}" for n in ("f0", "f1", "f2", "broken", "other")]
    got, skipped = read_readings(spark, paths, "no2", 2)
    assert sorted(float(r["value_text"]) for r in got.collect()) == [0.5, 1.5, 2.5]
    assert sorted(p.split("/")[-1] for p, _ in skipped) == ["broken", "other"]
    meta = spark.createDataFrame([("LU0104A", 6.0, 49.0, 1.0, "a", "b")], "station_eoi string, lon double, lat double, "
                                 "altitude double, station_area string, station_type string")
    assert {r["end_time"].minute for r in label_table(got, meta).collect()} == {30}  # the file's own end


def test_registry_counts_versions(spark):
    class Fitted:
        def write(self):
            return self

        def save(self, path):
            saved.append(path)

    saved, root = [], scratch_path(spark, "t-models")
    metrics = spark.createDataFrame([(1.0,)], "rmse double")
    for pol in ("no2", "no2", "pm25"):
        save_model(Fitted(), metrics, root, pol)
    assert [p.removeprefix(root + "/") for p in saved] == [
        "air_quality_no2/v1", "air_quality_no2/v2", "air_quality_pm25/v1"]
    assert {r["pollutant"]: r["version"] for r in latest_models(spark, root).collect()} == {"no2": 2, "pm25": 1}


def test_a_cluster_needs_a_shared_folder():
    class Unset:
        def get(self, key, default=None):
            return default

    class Nothing:
        def isDefined(self):
            return False

    class Session:
        conf = Unset()

        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                @staticmethod
                def sc():
                    class C:
                        @staticmethod
                        def getCheckpointDir():
                            return Nothing()
                    return C
    with pytest.raises(RuntimeError):
        shared_folder(Session())


def test_only_new(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    stored = spark.createDataFrame([("a",)], "k string")
    assert [r["k"] for r in only_new(df, stored, ["k"]).collect()] == ["b"]


def test_place_report_of_awkward_places(spark):
    fx = Fixtures(spark, SF)
    cell = fx.cell_weather.where("cams_pm25 IS NOT NULL AND clat BETWEEN 35 AND 54 AND clon BETWEEN -1 AND 23").first()
    rows = [("centre", cell["clat"], cell["clon"]), ("again", cell["clat"], cell["clon"]), ("pole", 90.0, 0.0),
            ("no latitude", None, 5.0), ("nowhere", None, None)]
    got = {r["id"]: r for r in field.place_report(fx, spark.createDataFrame(rows, "id string, lat double, lon double"), "id",
                                                  now=str(cell["valid_time"])).collect()}
    assert len(got) == 5 and all(got[i]["error"] == "out of theatre" and got[i]["reasons"] is None for i in ("pole", "no latitude", "nowhere"))
    assert got["centre"]["error"] is None and got["centre"]["pm25_prior"] == round(cell["cams_pm25"], 1)
    assert got["centre"][3:] == got["again"][3:] and got["centre"]["reasons"].startswith("raw CAMS prior")
    assert field.place_report(fx, spark.createDataFrame([], "id string, lat double, lon double"), "id").count() == 0


def test_written_by_a_column_reads_only_its_folders(spark):
    got = written(spark.range(100).selectExpr("id", "id % 5 AS fold"), "by-fold", by=["fold"])
    assert got.where("fold != 2").count() == 80 and got.where("fold = 2").select("id").distinct().count() == 20
    assert len(got.where("fold = 2").inputFiles()) <= len(got.inputFiles())
    assert "PartitionFilters: [isnotnull(fold" in got.where("fold = 2")._jdf.queryExecution().toString()
