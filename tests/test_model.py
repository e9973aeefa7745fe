"""Model path: leave-stations-out GBT beats the raw prior on the fixture (which carries
an hour and station-area signal the prior lacks); registry round trip."""

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def test_gbt_beats_prior_at_held_out_stations(spark):
    rows = {r["pollutant"]: r for r in E.queries()["gbt_oof"](spark, SF).collect()}
    assert set(rows) == {"no2", "pm25"}
    for r in rows.values():
        assert r["model_rmse"] < r["prior_rmse"]
        assert r["rmse_reduction"] > 0


def test_importance_from_latest_registered_model(spark):
    imp = E.queries()["feature_importance"](spark, SF).collect()
    assert {r["pollutant"] for r in imp} == {"no2", "pm25"}
    assert all(r["version"] == 1 for r in imp)
    for pol in ("no2", "pm25"):
        total = sum(r["importance"] for r in imp if r["pollutant"] == pol)
        assert abs(total - 1.0) < 1e-6
