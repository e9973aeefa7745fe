"""Late and repeated rows, panes, the refreshed field, folds with a tail, co-partitioned series."""

import datetime as dt
import hashlib
import os
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from airfill.operators import folds as FO
from airfill.operators import metrics as M
from airfill.operators import readings as R
from airfill.plans import context, field
from airfill.session import scratch_path
from airfill.sources.fixtures import Fixtures
from airfill.streaming import field as SF
from airfill.streaming import panes as P
from airfill.streaming import readings as ST

SF_DIR = "/root/testdata/sf0.001"
START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def fx(spark):
    return Fixtures(spark, SF_DIR)


def readings(spark, minutes):
    return spark.createDataFrame([(i, "s", "no2", START + dt.timedelta(minutes=m), 1.0 + i) for i, m in enumerate(minutes)],
                                 ST.READING_SCHEMA)


def delivered(spark, path, *batches):
    """Each batch as one file, in order."""
    for b in batches:
        b.coalesce(1).write.mode("append").parquet(path)
    return P.Feed(path, ST.READING_SCHEMA, "start_time", ["event_id"], files=1)


def test_late_rows_amend_their_panes(spark):
    root = scratch_path(spark, "late")
    all_rows = readings(spark, [5, 20, 70, 600, 610, 900])
    on_time, late = all_rows.where("event_id != 1"), all_rows.where("event_id = 1")
    feed = delivered(spark, f"{root}/in", on_time.where("event_id < 3"), on_time.where("event_id >= 2"), late)
    missing = P.panes(feed.stored(spark).where("event_id != 1"), "start_time", ["station_eoi"], {"total": F.col("value")})
    got = P.pane_stream(spark, feed, ["station_eoi"], {"total": F.col("value")}, root)
    want = P.panes(all_rows, "start_time", ["station_eoi"], {"total": F.col("value")})
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != sorted(map(tuple, missing.collect()))


def test_late_rows_are_found_by_the_deliveries_before(spark):
    root = scratch_path(spark, "late-found")
    feed = delivered(spark, f"{root}/in", readings(spark, [5, 600]), readings(spark, [479, 481, 620]), readings(spark, [499, 501]))
    found = []
    P.on_late_rows(spark, feed, root, lambda rows, first, last: found.append(sorted(r["start_time"] for r in rows.collect())))
    assert found == [[START + dt.timedelta(minutes=479)], [START + dt.timedelta(minutes=499)]]


def test_sliding_windows_equal_all_copies(spark):
    rows = [(k, START + dt.timedelta(hours=h), 1 + h % 3, float(h)) for k, hours in (("a", (0, 1, 5, 40)), ("b", (3,))) for h in hours]
    table = spark.createDataFrame(rows, "k string, window_start timestamp, n long, total double")
    got = {(r["k"], r["window_start"]): (r["n"], r["total"]) for r in P.sliding(table, ["k"], ["total"], 4).collect()}
    want = defaultdict(lambda: (0, 0.0))
    for k, t, n, total in rows:
        for i in range(4):
            a = want[k, t - dt.timedelta(hours=i)]
            want[k, t - dt.timedelta(hours=i)] = (a[0] + n, a[1] + total)
    assert got == dict(want)


def test_scored_rows_reach_the_table_however_late(spark, fx):
    r = fx.stream_readings.where("event_id < 150")
    p = fx.predictions
    table = ST.self_score_stream(spark, p, r, late=3)
    want = ST._scored(r, p).count()
    assert want == table.count() == table.select("event_id", "valid_time").distinct().count()


def test_the_scored_log_has_a_delivery_per_batch(spark, fx):
    # with many shuffle partitions a batch left a file for each, and the log was read in as many deliveries
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        _, log = ST.score_feeds(spark, fx.predictions, fx.stream_readings, scratch_path(spark, "f1"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    counts = defaultdict(int)
    for f in files_of(log.path):
        counts[os.path.dirname(f)] += 1
    assert counts and max(counts.values()) <= log.files


def files_of(path):
    return {os.path.join(d, f): hashlib.md5(open(os.path.join(d, f), "rb").read()).hexdigest()
            for d, _, names in os.walk(path.removeprefix("file:")) for f in names if f.endswith(".parquet")}


def test_refresh_writes_only_the_hours_touched(spark, fx):
    table = SF.field_table(fx, scratch_path(spark, "st7"))
    table.start()
    assert table.read().where("value IS NOT NULL").count() == 0
    before = files_of(table.path)
    hour = table.hours[3]
    batch = fx.cell_weather.where(F.col("valid_time") == F.lit(hour)).select("clat", "clon", "valid_time", *SF.CONDITIONS)
    other = fx.cell_weather.where(F.col("valid_time") < F.lit(table.hours[0])).select("clat", "clon", "valid_time", *SF.CONDITIONS)
    assert batch.count() and table.refresh(batch.unionByName(other)) == [hour]
    after = files_of(table.path)
    mark = f"hour={hour:%Y%m%d%H}"
    assert {f: h for f, h in before.items() if mark not in f} == {f: h for f, h in after.items() if mark not in f}
    want = sorted(map(tuple, field.field(fx).where(F.col("valid_time") == F.lit(hour)).collect()), key=repr)
    for _ in range(2):  # a repeated batch changes nothing
        assert sorted(map(tuple, table.read().where(F.col("valid_time") == F.lit(hour)).collect()), key=repr) == want
        table.refresh(batch)


def test_refresh_reads_one_hour_of_conditions(spark, fx):
    table = SF.field_table(fx, scratch_path(spark, "st7"))
    hours = table.hours[:2]
    table.refresh(fx.cell_weather.where(F.col("valid_time").isin(hours)).select("clat", "clon", "valid_time", *SF.CONDITIONS))
    stored = spark.read.parquet(table.stored).where(F.col("hour").isin([hours[0].strftime("%Y%m%d%H")]))
    assert all(hours[0].strftime("hour=%Y%m%d%H") in f for f in {r["f"] for r in stored.select(F.input_file_name().alias("f")).collect()})


def loads(rows):
    out = defaultdict(int)
    for r in rows:
        out[r["fold"]] += r["n"]
    return out


@pytest.mark.parametrize("heavy", [1000, 7, 2])
def test_fold_sizes_stay_within_the_bound(spark, heavy):
    sizes = [300, 170, 90, 90, 60] + [1 + i * 7 % 23 for i in range(400)]
    counts = spark.createDataFrame([(f"g{i:03}", n) for i, n in enumerate(sizes)], "g string, n long")
    rows = FO.folds_from_counts(counts, "g", "n", 5, heavy=heavy).collect()
    assert sorted(r["g"] for r in rows) == [f"g{i:03}" for i in range(len(sizes))]  # each group once, in one fold
    largest_tail = sorted(sizes, reverse=True)[min(heavy, len(sizes) - 1)]
    got = loads(rows)
    level = sum(sizes) / 5
    assert sum(got.values()) == sum(sizes)
    assert max(got.values()) <= max(level + largest_tail, max(sizes))
    if heavy == 1000:  # one by one: as the sequential greedy
        want = [0] * 5
        for n, _ in sorted(((n, f"g{i:03}") for i, n in enumerate(sizes)), key=lambda x: (-x[0], x[1])):
            want[want.index(min(want))] += n
        assert [got[i] for i in range(5)] == want


def test_fewer_groups_than_folds(spark):
    counts = spark.createDataFrame([("p", "a", 5), ("p", "b", 3), ("q", "c", 1)], "p string, g string, n long")
    got = {(r["p"], r["g"]): r["fold"] for r in FO.folds_from_counts(counts, "g", "n", 5, ["p"]).collect()}
    assert got == {("p", "a"): 0, ("p", "b"): 1, ("q", "c"): 0}


def test_stored_series_join_without_an_exchange(spark, fx):
    weather, prior = context.stored_series(fx)
    plan = context.joined_series(weather, prior)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_samples_are_the_same_for_any_partitioning(spark):
    df = spark.range(500).select(F.concat(F.lit("st"), F.col("id")).alias("code"))
    a, b = (R.sampled(df.repartition(n), "code", 25, "7") for n in (1, 13))
    assert [r[0] for r in a.collect()] == [r[0] for r in b.collect()]
    assert {r[0] for r in R.sampled(df, "code", 25, "8").collect()} != {r[0] for r in a.collect()}
    assert "TakeOrderedAndProject" in a._jdf.queryExecution().executedPlan().toString()


def test_quantiles_skip_what_is_not_finite(spark):
    rows = [(float(i),) for i in range(101)] + [(float("nan"),), (float("inf"),), (None,)]
    got = M.exact_quantiles(spark.createDataFrame(rows, "v double"), [], "v", 0.5, "m").first()
    assert (got["n"], got["m"]) == (101, 50.0)


def test_a_pair_of_codes_with_letters_is_in_one_half(spark, fx):
    code = F.conv(F.substring(F.md5(F.lit("DEBB021").cast("binary")), 1, 1), 16, 10).cast("int") % 2
    assert spark.range(1).select(code.alias("h")).first()["h"] in (0, 1)
