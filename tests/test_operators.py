"""Unit tests on tiny hand-written frames: traps T1-T13 and operator properties."""

import datetime as dt
import math
import random

import pytest

from pyspark.sql import functions as F

from airfill.functions import display as D
from airfill.functions import text as TX
from airfill.operators import folds as FO
from airfill.operators import metrics as M
from airfill.operators import readings as R
from airfill.operators import spatial as S
from airfill.operators.asof import asof_join


def ts(h, m=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=h, minutes=m)


def test_station_code(spark):
    df = spark.createDataFrame([("LU/SPO-LU0104A_00008_100",), ("SPO-BE1_x",), ("XX/ABC-1_2",),
                                ("AL/SPO-_1",), ("a/b/SPO-MT9A",)], "sp string")
    got = [r[0] for r in df.select(TX.station_code(F.col("sp"))).collect()]
    assert got == ["LU0104A", "BE1", None, None, "MT9A"]


def test_to_number_rejects_bad_text_and_non_finite(spark):
    df = spark.createDataFrame([("1.5",), ("n/a",), ("",), ("1.5d",), ("Infinity",), ("NaN",), (" 2e3 ",)], "t string")
    got = [r[0] for r in df.select(TX.to_number(F.col("t"))).collect()]
    assert got == [1.5, None, None, None, None, None, 2000.0]


def test_first_non_null_mixes_rows(spark):
    # One output row can combine columns of different input rows
    df = spark.createDataFrame([("s", 1, None, 5.0), ("s", 2, 7.0, 6.0)], "k string, o int, a double, b double")
    r = df.groupBy("k").agg(*R.first_non_null(["a", "b"], F.col("o"))).first()
    assert (r["a"], r["b"]) == (7.0, 5.0)


def test_distance_bins_are_right_closed_and_open_at_zero(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (10.01,), (100.0,), (150.0,), (None,)], "d double")
    got = [r[0] for r in df.select(D.distance_bin(F.col("d"))).collect()]
    assert got == [None, "<10", "10-25", "50-100", ">100", None]


def test_r2_null_for_constant_label(spark):
    df = spark.createDataFrame([(3.0, 1.0), (3.0, 2.0)], "y double, p double")
    r = df.agg(*M.error_metrics(F.col("y"), F.col("p"))).first()
    assert r["r2"] is None and r["rmse"] == round(math.sqrt(2.5), 6)


def test_asof_never_picks_a_later_row_and_keeps_rows_whole(spark):
    left = spark.createDataFrame([("a", ts(1)), ("a", ts(3)), ("a", ts(0)), ("b", ts(5))], "k string, t timestamp_ntz")
    right = spark.createDataFrame(
        [("a", ts(1), 10.0, 1.0), ("a", ts(2), None, 2.0), ("a", ts(4), 40.0, 4.0)],
        "k string, vt timestamp_ntz, x double, y double")
    got = {(r["k"], r["t"]): (r["x"], r["y"]) for r in asof_join(left, right, "k", "t", "vt").collect()}
    # equal time matches; the NULL x of the 02:00 row is not filled from 01:00; no match -> dropped
    assert got == {("a", ts(1)): (10.0, 1.0), ("a", ts(3)): (None, 2.0)}


def test_asof_carries_across_buckets(spark):
    # the only feature is days before the label: found through the carry-in row
    left = spark.createDataFrame([("a", ts(24 * 5 + 3))], "k string, t timestamp_ntz")
    right = spark.createDataFrame([("a", ts(2), 7.0), ("a", ts(24 * 6), 9.0)], "k string, vt timestamp_ntz, x double")
    got = asof_join(left, right, "k", "t", "vt", bucket="day").collect()
    assert [r["x"] for r in got] == [7.0]
    left_join = asof_join(left.union(spark.createDataFrame([("z", ts(1))], left.schema)), right, "k", "t", "vt",
                          how="left").collect()
    assert sorted((r["k"], r["x"]) for r in left_join) == [("a", 7.0), ("z", None)]


def test_asof_tolerance(spark):
    left = spark.createDataFrame([("a", ts(10))], "k string, t timestamp_ntz")
    right = spark.createDataFrame([("a", ts(1), 1.0)], "k string, vt timestamp_ntz, x double")
    assert asof_join(left, right, "k", "t", "vt", tolerance="6 hours").count() == 0
    assert asof_join(left, right, "k", "t", "vt", tolerance="12 hours").count() == 1


def _points(n, seed):
    rnd = random.Random(seed)
    return [(f"p{i}", 40 + rnd.random() * 15, -5 + rnd.random() * 25) for i in range(n)]


def test_knn_equals_brute_force(spark):
    pts = spark.createDataFrame(_points(60, 1), "pid string, lat double, lon double")
    sites = spark.createDataFrame(_points(40, 2), "site string, s_lat double, s_lon double")
    got = S.knn(pts, sites, 3, ["pid"], "site", metric="haversine")
    brute = (pts.crossJoin(sites)
                .withColumn("d", S.METRICS["haversine"](F.col("lat"), F.col("lon"), F.col("s_lat"), F.col("s_lon"))))
    from pyspark.sql import Window
    brute = (brute.withColumn("rank", F.row_number().over(Window.partitionBy("pid").orderBy("d", "site")))
                  .filter("rank <= 3"))
    a = sorted((r["pid"], r["rank"], r["site"]) for r in got.collect())
    b = sorted((r["pid"], r["rank"], r["site"]) for r in brute.collect())
    assert a == b


def _brute(points, sites, k, metric):
    r = math.radians

    def dist(a, b):
        (la, lo), (lb, lp) = a, b
        if metric == "haversine":
            h = math.sin(r(lb - la) / 2) ** 2 + math.cos(r(la)) * math.cos(r(lb)) * math.sin(r(lp - lo) / 2) ** 2
            return 2 * 6371.0 * math.asin(min(1, math.sqrt(h)))
        c = {"planar": 1.0, "equirect_mean": math.cos(r((la + lb) / 2)), "equirect_point": math.cos(r(la))}[metric]
        return math.hypot((lb - la) * 111.0, (lp - lo) * 111.0 * c)
    return {(p, n + 1): (s, round(d, 6)) for p, at in points.items() for n, (d, s) in
            enumerate(sorted((dist(at, b), s) for s, b in sites.items())[:k])}


@pytest.mark.parametrize("metric", ["haversine", "planar", "equirect_mean", "equirect_point"])
def test_knn_at_the_seam_poles_and_far_from_a_cluster(spark, metric):
    rng = random.Random(6)
    points = {0: (10.0, 179.99), 1: (10.0, -179.99), 2: (89.9, 20.0), 3: (-89.9, -100.0), 4: (-40.0, -150.0), 5: (50.0, 10.0),
              6: (0.0, 180.0), 7: (0.0, -180.0), **{i: (rng.uniform(-85, 85), rng.uniform(-180, 180)) for i in range(10, 40)}}
    sites = {i: (48 + rng.gauss(0, 0.2), 11 + rng.gauss(0, 0.2)) for i in range(300)}
    sites |= {1000 + i: (rng.uniform(-88, 88), rng.uniform(-180, 180)) for i in range(60)}
    sites |= {2000: (10.01, -179.98), 2001: (10.01, 179.98), 2002: (0.0, 179.9), 2003: (0.0, -179.9), 2004: (48.0, 11.0), 2005: (48.0, 11.0)}
    p = spark.createDataFrame([(i, *at) for i, at in points.items()], "pid long, lat double, lon double")
    s = spark.createDataFrame([(i, *at) for i, at in sites.items()], "site long, s_lat double, s_lon double")
    got = {(r["pid"], r["rank"]): (r["site"], round(r["dist_km"], 6)) for r in S.knn(p, s, 3, ["pid"], "site", metric=metric).collect()}
    assert got == _brute(points, sites, 3, metric)


def test_far_points_do_not_meet_a_whole_cluster(spark):
    n = 20000
    s = spark.range(n).selectExpr("id site", "48 + (id % 141) / 141.0D s_lat", "11 + (id / 141) / 142.0D s_lon")
    p = spark.range(40).selectExpr("id pid", "-30 - id / 4.0D lat", "-60 + id / 3.0D lon")
    found = S.knn(p, s, 1, ["pid"], "site")
    assert found.count() == 40
    rows = _join_rows(found)
    assert rows and max(rows) < 40 * n / 20  # candidates met, against 800,000 pairs


def _join_rows(df):
    """Output rows of each join of the plan that ran."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    out, stack = [], [plan.finalPhysicalPlan() if hasattr(plan, "finalPhysicalPlan") else plan]
    while stack:
        node = stack.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            stack.append(node.executedPlan())
            continue
        if "QueryStage" in name:
            stack.append(node.plan())
            continue
        if "Join" in name and node.metrics().contains("numOutputRows"):
            out.append(node.metrics().apply("numOutputRows").value())
        kids = node.children()
        stack += [kids.apply(i) for i in range(kids.size())]
    return out


@pytest.mark.parametrize("lon,other", [(179.98, -179.98), (-179.98, 179.98)])
def test_radius_search_crosses_the_seam(spark, lon, other):
    st = spark.createDataFrame([("A", 10.0, lon)], "station_eoi string, lat double, lon double")
    px = spark.createDataFrame([(1, 10.0, other), (2, 10.0, lon + 1 if lon < 0 else lon - 1)],
                               "pixel_id long, s_lat double, s_lon double")
    got = S.nearest_within(st, px, 8.0, ["station_eoi"], "pixel_id").collect()
    assert [r["pixel_id"] for r in got] == [1] and abs(got[0]["dist_km"] - 4.38) < 0.02


def test_nearest_other_excludes_self(spark):
    st = spark.createDataFrame([("a", 50.0, 5.0), ("b", 50.0, 5.0), ("c", 51.0, 5.0)], "station_eoi string, lat double, lon double")
    got = {r["station_eoi"]: r["dist_km"] for r in S.nearest_other(st, "planar").collect()}
    assert got["a"] == 0.0 and got["b"] == 0.0 and abs(got["c"] - 111.0) < 1e-9


def test_radius_nearest_respects_radius(spark):
    st = spark.createDataFrame([("s", 50.0, 5.0)], "station_eoi string, lat double, lon double")
    px = spark.createDataFrame([(1, 50.0, 5.1), (2, 50.0, 5.05), (3, 50.2, 5.0)],
                               "pixel_id long, s_lat double, s_lon double")
    got = S.nearest_within(st, px, 8.0, ["station_eoi"], "pixel_id").collect()
    assert [r["pixel_id"] for r in got] == [2]
    assert abs(got[0]["dist_km"] - 3.57) < 0.05


def test_folds_never_share_a_group_and_balance(spark):
    rows = [(f"s{i}", j) for i in range(23) for j in range(1 + i % 7)]
    df = spark.createDataFrame(rows, "station string, j int")
    f = FO.balanced_folds(df, "station", 5).collect()
    assert len({r["station"] for r in f}) == 23 == len(f)
    sizes = {}
    for r in f:
        sizes[r["fold"]] = sizes.get(r["fold"], 0) + r["n"]
    assert set(sizes) == set(range(5))
    assert max(sizes.values()) - min(sizes.values()) <= 7


def test_global_rank_is_dense_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    r = FO.global_rank(df, [F.col("v")], partitions=7).collect()
    assert sorted(x["_rank"] for x in r) == list(range(1000))
    assert all(x["_rank"] == x["v"] for x in r)


def test_ramp_and_opacity(spark):
    df = spark.createDataFrame([(0.0, 10.0), (1.0, 100.0), (0.3, 400.0)], "t double, d double")
    got = df.select(D.ramp(F.col("t"), D.PRED_STOPS).alias("c"), D.opacity(F.col("t"), F.col("d")).alias("a")).collect()
    assert tuple(got[0]["c"]) == (254, 249, 195) and tuple(got[1]["c"]) == (127, 29, 29)
    assert tuple(got[2]["c"]) == (251, 191, 36)
    assert abs(got[0]["a"] - 0.62) < 1e-12 and abs(got[2]["a"] - (0.62 + 0.36 * math.sqrt(0.3)) * 0.3) < 1e-12
