"""What keeps steps in proportion to their input: rows that joins give out, sorts, and how often a table is read."""

import random

import pytest
from pyspark.sql import functions as F

from airfill.operators import spatial as S
from airfill.sources.fixtures import Fixtures
from tests.test_operators import _join_rows

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture()
def fx(spark):
    return Fixtures(spark, SF_DIR)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_points_of_a_cell_descend_together(spark):
    # each point met every level's cells of its own
    rnd = random.Random(3)
    p = spark.createDataFrame([(i, 50 + rnd.random() / 5, 10 + rnd.random() / 5) for i in range(3000)], "pid long, lat double, lon double")
    s = spark.createDataFrame([(i, 45 + rnd.random() * 10, 5 + rnd.random() * 10) for i in range(200)], "site long, s_lat double, s_lon double")
    found = S.knn(p, s, 1, ["pid"], "site")
    assert found.count() == 3000
    assert sum(_join_rows(found)) < 4 * 3000


def test_more_sites_in_a_cell_than_an_array_holds(spark, monkeypatch):
    monkeypatch.setattr(S, "PACK", 7)
    s = spark.range(100).selectExpr("id site", "50 + id / 1e6D s_lat", "10D s_lon")
    p = spark.createDataFrame([(1, 50.0, 10.0), (2, 50.1, 10.0)], "pid long, lat double, lon double")
    got = {(r["pid"], r["rank"]): r["site"] for r in S.knn(p, s, 3, ["pid"], "site").collect()}
    assert got == {(1, 1): 0, (1, 2): 1, (1, 3): 2, (2, 1): 99, (2, 2): 98, (2, 3): 97}


def test_the_hour_of_a_place_report_is_a_constant(spark, fx):
    # its scalar subquery could be unfinished when the broadcast of the hour's cells asked for it
    from airfill.plans import field
    assert "ubquery" not in plan_of(field.place_report(fx, fx.places, "place_id"))


def test_idw_joins_days_not_readings(fx):
    # each label met its neighbours' readings row by row
    from airfill.plans import evaluation
    p = evaluation.idw_predictions(fx)
    assert max(_join_rows(p)) < p.count()


def test_equal_labels_of_an_hour_count_their_neighbours_each_time(spark, fx, monkeypatch):
    import datetime as dt
    from airfill.plans import evaluation, training
    t = dt.datetime(2024, 1, 1)
    rows = [("a", 1.0, 50.0), ("a", 1.0, 50.0), ("b", 3.0, 50.1), ("b", 5.0, 50.1), ("c", 7.0, 52.0)]
    ts = spark.createDataFrame([(s, "no2", t, v, lat, 5.0) for s, v, lat in rows] + [("d", "no2", t + dt.timedelta(hours=1), 9.0, 50.0, 5.0)],
                               "station_eoi string, pollutant string, start_time timestamp_ntz, value double, lat double, lon double")
    monkeypatch.setattr(training, "training_set", lambda _: ts)
    got = {(r["station_eoi"], r["value"]): (r["idw"], r["neighbours"]) for r in evaluation.idw_predictions(fx).collect()}
    assert len(got) == 5 and got["a", 1.0][1] == 6 and got["b", 3.0][1] == 3 and got["d", 9.0] == (None, 0)
    assert 4.0 < got["a", 1.0][0] < 4.1


def test_sliding_windows_are_made_without_sorting_them(spark):
    # every window was a row that a second window function sorted again
    from airfill.streaming import panes as P
    table = spark.range(50).selectExpr("'a' k", "timestamp_seconds(id * 7200) window_start", "id n", "id * 1.0D total")
    assert plan_of(P.sliding(table, ["k"], ["total"], 24)).split("== Initial Plan ==")[0].count("Sort [") == 1


def test_sums_of_no_values_stay_null(spark):
    from airfill.streaming import panes as P
    table = spark.createDataFrame([("a", 0, 1, None), ("a", 3600, 2, 5.0)], "k string, s long, n long, total double").selectExpr(
        "k", "timestamp_seconds(s) window_start", "n", "total")
    got = sorted((r["window_start"], r["n"], r["total"]) for r in P.sliding(table, ["k"], ["total"], 2).collect())
    assert [x[1:] for x in got] == [(1, None), (3, 5.0), (2, 5.0)]


def test_labels_are_told_apart_narrow_and_sorted_once(fx):
    # Rows were placed first, shuffled with their station's columns, and sorted before and after
    from airfill.plans import ingest
    plan = plan_of(ingest.labels(fx))
    assert "WindowGroupLimit" not in plan
    assert not any("station_area" in line or "altitude" in line for line in plan.splitlines()
                   if "Exchange" in line and "start_time" in line)


def test_the_last_row_of_a_bucket_is_found_without_a_sort(spark):
    from airfill.operators.asof import asof_join
    left = spark.range(9).selectExpr("cast(id as string) k", "timestamp_ntz'2024-01-01' t")
    right = left.selectExpr("k", "t vt", "1.0D x")
    assert "SortAggregate" not in plan_of(asof_join(left, right, "k", "t", "vt"))


def test_days_to_do_reads_the_labels_once(fx):
    from airfill.plans import ingest
    assert not [f for f in ingest.days_to_do(fx).inputFiles() if "lineitem" in f]


def test_numbers_are_read_where_rows_are_dropped(spark):
    from airfill.functions.text import numbers
    df = spark.createDataFrame([("1.5",), ("n/a",), (None,), ("1e999",), (" 2e3 ",), ("1.5d",)], "t string")
    assert [r[0] for r in df.select(F.explode(numbers("t"))).collect()] == [1.5, 2000.0]


def test_stations_of_a_cell_share_its_series(fx):
    # Each station had a copy of its cell's series, which the as-of join shuffled and sorted
    from airfill.operators import readings as R
    from airfill.plans import training
    training.feature_view(fx)
    assert fx._cache["shared:feature-rows"].count() == R.drop_missing_prior(fx.cell_weather).count()


def test_readings_are_cleaned_in_generated_code(fx):
    # The number was tested by a lambda, which is interpreted, row by row
    from airfill.operators import readings as R
    assert "lambda" not in plan_of(R.clean_readings(fx.raw_readings, 2019))


def test_a_number_and_a_code_read_as_by_their_patterns(spark):
    import re
    from airfill.functions.text import station_code, to_number
    texts = ["1", "1.", ".5", "1.5", "+1.5", "1e3", "1.5d", " 2 ", "2\n", "", ".", "1.2.3", "n/a", "NaN", "9" * 400, "0x1", "١"]
    codes = ["LU/SPO-LU0104A_00008_100", "SPO-A", "SPO-", "a/SPO-_x", "SPO-A/b", "x/SPO-A/SPO-B_c", "xSPO-A", "a/b", "", "SPO-A_b/", "spo-A"]
    got = [tuple(r) for r in spark.createDataFrame([(t, c) for t in texts for c in codes], "t string, c string").select(
        "t", "c", to_number("t").alias("n"), station_code("c").alias("s")).collect()]
    number = re.compile(r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*$", re.ASCII)
    for t, c, n, s in got:
        m, k = number.match(t), re.search(r"(?:^|/)SPO-([^_/]*)[^/]*$", c)
        assert n == (float(m[1]) if m and float(m[1]) < float("inf") else None), t
        assert s == ((k[1] or None) if k else None), c


def test_temporal_features_are_looked_up_as_computed(spark, fx):
    # four roundings of a double in every training row
    from airfill.functions import temporal as TM
    from airfill.plans import training
    for period, values in ((24.0, 24), (365.25, 367)):
        n = F.col("id").cast("double")
        computed = [TM.rounded(c, 6) for c in TM.cyclic(n, period)]
        looked = TM.cyclic_table(F.col("id").cast("int"), period, values, 6)
        bad = spark.range(values).where(~(computed[0].eqNullSafe(looked[0]) & computed[1].eqNullSafe(looked[1])))
        assert bad.count() == 0
    assert "SIN(" not in plan_of(training.training_set(fx)).upper()


def test_a_fit_reads_its_pollutant_only_and_rows_are_written_by_fold_once(fx, monkeypatch):
    # both pollutants' rows, with columns no fit reads, and a copy before the one by fold
    from airfill.operators import model as MD
    from airfill.plans import evaluation
    read, kept, names = [], MD.fit, []
    monkeypatch.setattr(MD, "fit", lambda t, *a, **k: (read.append((plan_of(t), t.columns)), kept(t, *a, **k))[1])
    keep = evaluation.written
    monkeypatch.setattr(evaluation, "written", lambda df, name, by=(): (names.append(name), keep(df, name, by))[1])
    evaluation.trained_models(fx, evaluation.scratch_path(fx.spark, "models"), {"maxIter": 1, "maxDepth": 2}, evaluate=False)
    assert read and all("PartitionFilters: [isnotnull(pollutant" in plan for plan, _ in read)
    assert not any("start_time" in columns for _, columns in read)
    evaluation.out_of_fold(fx, {"maxIter": 1, "maxDepth": 2})
    assert "oof-inputs" not in names and not any("station_type" in columns for _, columns in read)


def test_rows_meet_stations_only_where_their_columns_are_read(fx):
    # Every training row was joined with its station before it was written, and written with its columns
    from airfill.plans import training
    ts = training.training_set(fx)
    assert not any("station_type" in f.columns for f in [fx._cache["shared:feature-view"]])
    assert "supplier" not in plan_of(ts.select("station_eoi", "pollutant", "value", "prior"))
    assert ts.where("lat IS NULL OR station_area IS NULL").count() == 0 < ts.count()


def test_the_size_of_what_training_rows_meet_is_known_before(fx):
    # The rows were shuffled for a join with a table of a few rows a station, twice
    from airfill.plans import context
    plan = plan_of(context.extended_features(fx))
    assert plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning(station_eoi") == 0


def test_left_rows_are_told_apart_within_the_join(spark):
    # Labels were told apart by a shuffle, a sort and a table of their own before the as-of join
    from airfill.operators import readings as R
    from airfill.operators.asof import asof_join
    rnd = random.Random(5)
    some = lambda *x: rnd.choice([None, *x])
    left = spark.createDataFrame(
        [(rnd.randrange(3), rnd.randrange(60), some("p", "q"), some(1, 2), some(1, 2, 3), rnd.randrange(3), some(1.0, 2.0), i) for i in range(2000)],
        "k int, h int, sp string, dataset int, row_id long, validity long, value double, i long").selectExpr(
        "*", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, h) t")
    right = spark.range(40).selectExpr("cast(id % 3 as int) k", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, cast(id * 7 % 50 as int)) vt", "id x")
    order = [*R.label_order(), F.col("i")]
    for how in ("inner", "left"):
        got = asof_join(left, right, "k", "t", "vt", how=how, left_cols=["sp", "t", "value", "i"], once=["sp"], order=order)
        first = R.dedupe_latest(left, ["k", "sp", "t"], order).select("k", "sp", "t", "value", "i")
        assert got.exceptAll(asof_join(first, right, "k", "t", "vt", how=how)).count() == 0
        assert got.count() == (first.count() if how == "left" else asof_join(first, right, "k", "t", "vt").count()) > 100


def test_readings_become_matched_labels_by_one_shuffle(fx, monkeypatch):
    from airfill.operators import readings as R
    from airfill.plans import training
    monkeypatch.setattr(R, "dedupe_latest", lambda *a, **k: pytest.fail("a shuffle and a sort of their own"))
    plan = plan_of(training.matched(fx)).split("== Initial Plan ==")[-1]
    assert sum("Window [" in line for line in plan.splitlines()) == 2  # the small one finds what an earlier day hands over


def test_a_station_code_is_not_read_again_where_rows_are_read(fx):
    # That the code isn't NULL was asked inside the first join, by its whole expression many times a reading
    from airfill.operators import readings as R
    from airfill.plans import ingest
    for df in (ingest.labels(fx), R.label_rows(fx.raw_readings, ingest.stations(fx))):
        assert not any("SPO-)" in line for line in plan_of(df).splitlines() if "Join" in line or "Filter" in line)


def test_a_lookup_matches_as_the_as_of_join(spark):
    # Left rows were sorted by their whole contents, together with the right ones
    from airfill.operators import readings as R
    from airfill.operators.asof import asof_join, asof_lookup
    rnd = random.Random(7)
    some = lambda *x: rnd.choice([None, *x])
    left = spark.createDataFrame(
        [(rnd.randrange(4), rnd.randrange(300), some("p", "q"), some(1, 2), some(1, 2, 3), rnd.randrange(3), some(1.0, 2.0), i) for i in range(3000)],
        "k int, h int, sp string, dataset int, row_id long, validity long, value double, i long").selectExpr(
        "*", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, h) t")
    # days without a right row, one with many, and a key without any
    right = spark.range(60).selectExpr("cast(id % 3 as int) k", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, cast(id * id % 241 as int), 1) vt",
                                       "if(id % 5 = 0, null, id) x").dropDuplicates(["k", "vt"]).cache()
    order = [*R.label_order(), F.col("i")]
    every_day = left.select("k").distinct().crossJoin(left.select("t").distinct())
    want = asof_join(left, right, "k", "t", "vt", left_cols=["sp", "t", "value", "i"], once=["sp"], order=order)
    for buckets in (left, every_day):
        got = asof_lookup(left, right, "k", "t", "vt", ["x"], ["sp", "t", "value", "i"], buckets, once=["sp"], order=order)
        assert got.exceptAll(want).count() == 0 and got.count() == want.count() > 500
    everything = asof_lookup(left, right, "k", "t", "vt", ["x"], ["sp", "t", "value", "i"], left)
    assert everything.exceptAll(asof_join(left, right, "k", "t", "vt", left_cols=["sp", "t", "value", "i"])).count() == 0
    plan = plan_of(got)
    assert "[_w0" in [line for line in plan.splitlines() if "Sort [" in line and "sp#" in line][0]


def test_readings_are_not_written_before_they_meet_the_weather(fx):
    # They were written and read twice, to find the days that hold any
    from airfill.plans import training
    plan = plan_of(training.matched(fx))
    assert "shared:label-candidates" not in fx._cache
    assert plan.count("l_orderkey") and fx._cache["shared:reading-days"].columns == ["start_time"]


def test_stations_are_sent_to_the_readings_beyond_sparks_limit(spark, monkeypatch):
    # All readings, pixels and weather rows were shuffled and sorted to meet some thousand stations
    from airfill import session
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for view in ("raw_readings", "cell_weather", "pixels"):
            assert "BroadcastHashJoin" in plan_of(Fixtures(spark, SF_DIR).table(view))
        monkeypatch.setattr(session, "BROADCAST_ROWS", 3)
        assert "SortMergeJoin" in plan_of(Fixtures(spark, SF_DIR).raw_readings)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_the_prior_report_counts_rows_without_writing_them(spark, fx, monkeypatch):
    # the whole feature view was written to be counted and read again
    from airfill.operators import metrics as M
    from airfill.plans import training
    got = training.prior_report(fx)
    assert "shared:feature-view" not in fx._cache
    want = M.report(training.training_set(fx), ["pollutant"], "value", {"prior": "prior"})
    assert got.drop("prior_r2", "prior_rmse").exceptAll(want.drop("prior_r2", "prior_rmse")).count() == 0 < got.count() == want.count()
    monkeypatch.setattr(training, "MIN_ROWS", min(r["n"] for r in got.collect()) + 1)
    assert training.prior_report(fx).count() < got.count()


def test_a_distance_is_joined_without_moving_the_rows(fx):
    # rows were written with every column and then with four, and shuffled to meet a few distances
    from airfill.plans import training
    plan = plan_of(training.mae_by_distance(fx))
    assert "shared:feature-view" not in fx._cache
    assert "Exchange hashpartitioning(station_eoi" not in plan


def test_satellite_days_meet_the_rows_unmoved(spark, fx):
    # F16: rows were written twice and shuffled to meet a few days of pixels
    from airfill.plans import evaluation
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    names, keep = [], evaluation.written
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        evaluation.written = lambda df, name, by=(): (names.append((name, plan_of(df))), keep(df, name, by))[1]
        evaluation.satellite_baseline(fx)
    finally:
        evaluation.written = keep
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "shared:feature-view" not in fx._cache
    plan = dict(names)["satellite-fit"]
    assert "LeftOuter, BuildRight" in plan and "hashpartitioning(station_eoi" not in plan
