"""Evaluation (Q5): folds, gradient-boosted gap filling, baselines and monitoring.

M3/M4 folds, M5-M9 model path, M10 IDW, M11/M12/M16 targets, M13 satellite baseline,
M14 importance, M15 low-confidence flags, AG15 drift, SK3/SK4 model registry.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airfill.operators import features as FE
from airfill.operators import folds as FO
from airfill.operators import metrics as M
from airfill.operators import model as MD
from airfill.operators import readings as R
from airfill.operators import spatial as S
from airfill.plans import field as FLD
from airfill.plans import ingest, satellite, training
from airfill.session import checkpoint, scratch_path, sent_if_small, written
from airfill.sources.fixtures import Fixtures

# Fixed values
K_FOLDS = 5
IDW_NEIGHBOURS = 5
BLOCK_DEG = 1.0
NULLABLE = ["altitude"]
SATELLITE_OF = {"no2": "no2_column", "pm25": "aerosol_index"}
DRIFT_DAYS = 7
PRIOR_EDGES = [5.0, 10.0, 15.0, 20.0, 25.0, 30.0, 35.0, 40.0]
TEMP_EDGES = [-5.0, 0.0, 5.0, 10.0, 15.0, 20.0, 25.0]


def fold_assignment(fx: Fixtures) -> DataFrame:
    """M3: leave-stations-out folds per pollutant."""
    return FO.balanced_folds(training.training_set(fx), "station_eoi", K_FOLDS, by=["pollutant"])


def spatial_folds(fx: Fixtures) -> DataFrame:
    """M4: spatial-block folds per pollutant (1-degree blocks)."""
    return FO.spatial_block_folds(training.training_set(fx), "station_eoi", "lat", "lon",
                                  BLOCK_DEG, K_FOLDS, by=["pollutant"])


def _model_inputs(fx: Fixtures) -> tuple[DataFrame, list[str]]:
    ts = training.training_set(fx)
    ts, flags = MD.with_missing_flags(ts, NULLABLE)
    return ts, FE.feature_columns(ts, weather=("temp", "wind_dir"), priors=("cams_no2", "cams_pm25")) + flags


def out_of_fold(fx: Fixtures, params: dict | None = None) -> DataFrame:
    """M5: leave-stations-out predictions of every pollutant (folds of M3), written once."""
    # cheap columns over the written feature view: the rows are written once more, by fold
    ts, feats = _model_inputs(fx)
    folds = checkpoint(FO.balanced_folds(ts, "station_eoi", K_FOLDS, by=["pollutant"]))
    out = None
    for pol in FE.PRIOR_OF:
        fpol = folds.filter(F.col("pollutant") == pol).select("station_eoi", "fold")
        oof = MD.out_of_fold(ts.filter(F.col("pollutant") == pol), fpol, feats,
                             keys=["pollutant", "start_time", "prior", "lat", "lon", "fold"], params=params, impute=NULLABLE)
        if oof is not None:
            out = oof if out is None else out.unionByName(oof)
    return written(out, "oof")


def oof_metrics(oof: DataFrame) -> DataFrame:
    """M9 + AG7 on out-of-fold rows: model beside prior, with the error reduction."""
    rep = M.report(oof, ["pollutant"], "value", {"model": "prediction", "prior": "prior"})
    return rep.withColumns({"rmse_reduction": M.reduction("model_rmse", "prior_rmse"),
                            "mae_reduction": M.reduction("model_mae", "prior_mae")})


def gbt_report(fx: Fixtures, params: dict | None = None) -> DataFrame:
    """Q5: leave-stations-out GBT vs the raw prior per pollutant."""
    return oof_metrics(out_of_fold(fx, params))


def model_mae_by_distance(fx: Fixtures, params: dict | None = None) -> DataFrame:
    """AG8 as the source reports it: out-of-fold model MAE beside the prior's, per pollutant and
    distance bin to the nearest other station."""
    withd = training.with_nearest_other(fx, out_of_fold(fx, params))
    return M.mae_by_distance(withd, ["pollutant"], "value", "dist_km", {"model": "prediction", "prior": "prior"})


def trained_models(fx: Fixtures, root: str, params: dict | None = None, evaluate: bool = True) -> tuple[dict, list[str]]:
    """M7 + SK3 + SK4: the final fit of each pollutant on all rows, registered under ``root`` with
    its out-of-fold metrics (without ``evaluate`` the row count and the prior's metrics only),
    and the newest registered models read back."""
    spark = fx.spark
    ts, feats = _model_inputs(fx)
    # a folder per pollutant with the columns that fits and metrics read: no fit decodes the other's rows
    ts = written(ts.select("pollutant", "station_eoi", "value", "prior", *feats), "train-inputs", by=["pollutant"])
    held_out = written(gbt_report(fx, params) if evaluate else M.report(ts, ["pollutant"], "value", {"prior": "prior"}),
                       "model-metrics")
    for pol in FE.PRIOR_OF:
        sub = ts.filter(F.col("pollutant") == pol)
        if not sub.isEmpty():
            MD.save_model(MD.fit(sub, feats, params=params, impute=NULLABLE),
                          held_out.filter(F.col("pollutant") == pol).drop("pollutant"), root, pol)
    return {r["pollutant"]: (r["version"], PipelineModel.load(r["path"])) for r in MD.latest_models(spark, root).collect()}, feats


def importance_and_registry(fx: Fixtures, params: dict | None = None) -> DataFrame:
    """Importances of the newest registered version of each pollutant."""
    models, feats = trained_models(fx, scratch_path(fx.spark, "models"), params)
    out = None
    for pol, (version, m) in sorted(models.items()):
        imp = (MD.feature_importance(fx.spark, m, feats)
                 .withColumns({"pollutant": F.lit(pol), "version": F.lit(version)}))
        out = imp if out is None else out.unionByName(imp)
    return out


def model_field(fx: Fixtures, params: dict | None = None) -> DataFrame:
    """Q6 in model mode: the newest registered models score the whole field."""
    models, _ = trained_models(fx, scratch_path(fx.spark, "models"), params, evaluate=False)
    return FLD.field(fx, {pol: m for pol, (_, m) in models.items()})


def idw_predictions(fx: Fixtures, k: int = IDW_NEIGHBOURS) -> DataFrame:
    """Inverse-distance (1/d^2, great circle) estimate of each label from the k
    nearest *other* stations measuring the pollutant at the same hour; a co-located
    neighbour (d = 0) gives its value directly."""
    ts = written(training.training_set(fx).select("station_eoi", "pollutant", "start_time", "value", "lat", "lon"), "idw-labels")
    st = ts.groupBy("station_eoi", "pollutant").agg(*R.first_non_null(["lat", "lon"], F.col("start_time")))
    st = checkpoint(st)
    sites = st.select(F.col("station_eoi").alias("site"), "pollutant",
                      F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"))
    nbr = S.knn(st, sites, k, ["station_eoi", "pollutant"], "site", metric="haversine",
                group=["pollutant"], exclude_self="station_eoi")
    # a station's day is one row, so that a neighbour's values travel together
    days = written(ts.groupBy("station_eoi", "pollutant", F.to_date("start_time").alias("day"))
                     .agg(F.collect_list(F.struct("start_time", "value")).alias("seen")), "idw-days")
    near = (nbr.select("station_eoi", "pollutant", "site", "dist_km")
               .join(days.withColumnsRenamed({"station_eoi": "site", "seen": "theirs"}), ["site", "pollutant"])
               .groupBy("station_eoi", "pollutant", "day").agg(F.collect_list(F.struct("dist_km", "theirs")).alias("near")))

    def beside(own: Column) -> Column:
        """Distance and value of each neighbour's readings of the hour of ``own``."""
        return F.flatten(F.transform(F.coalesce("near", F.array()), lambda n: F.transform(
            F.filter(n["theirs"], lambda x: x["start_time"] == own["start_time"]),
            lambda x: F.struct(n["dist_km"].alias("d"), x["value"].alias("v")))))

    j = days.join(near, ["station_eoi", "pollutant", "day"], "left")
    # equal labels of an hour are one row that counts their neighbours each time
    rows = j.select("station_eoi", "pollutant", F.explode(F.transform(F.array_distinct("seen"), lambda own: F.struct(
        own["start_time"].alias("start_time"), own["value"].alias("value"), beside(own).alias("at"),
        F.size(F.filter("seen", lambda x: x == own)).alias("times")))).alias("_x")).select("station_eoi", "pollutant", "_x.*")

    def total(of: Column, of_each) -> Column:
        return F.aggregate(of, F.lit(0.0), lambda a, x: a + of_each(x))

    there = F.filter("at", lambda x: x["d"] == 0)
    apart = F.filter("at", lambda x: x["d"] > 0)
    zero = F.try_divide(total(there, lambda x: x["v"]), F.size(there))
    idw = F.try_divide(total(apart, lambda x: x["v"] / (x["d"] * x["d"])), total(apart, lambda x: F.lit(1.0) / (x["d"] * x["d"])))
    return rows.select("station_eoi", "pollutant", "start_time", "value", F.coalesce(zero, idw).alias("idw"),
                       (F.size("at") * F.col("times")).cast("long").alias("neighbours"))


def idw_report(fx: Fixtures) -> DataFrame:
    """M10 + AG6: IDW baseline metrics per pollutant over the labels with a neighbour value that
    hour, and how many labels have none."""
    p = written(idw_predictions(fx), "idw")
    none = p.groupBy("pollutant").agg(F.sum(F.when(F.col("idw").isNull(), 1).otherwise(0)).alias("without_neighbour"))
    return M.report(p.where(F.col("idw").isNotNull()), ["pollutant"], "value", {"idw": "idw"}).join(none, "pollutant")


def held_out_station(code: Column | None = None) -> Column:
    """Whether a station is kept from training for scoring: about one in five, by a hash of its code."""
    return F.substring(F.md5((F.col("station_eoi") if code is None else code).cast("binary")), 1, 1).isin(*"012")


def grid_scores(fx: Fixtures, models: dict | None = None) -> DataFrame:
    """The field's value at the grid cell of each held-out station beside its reading of that
    hour. A station's cell is a computed key (J13), so the field meets the readings by one equi
    join on cell, hour and pollutant; stations outside the grid have no cell. The readings
    are bounded by the field's hours before the join."""
    st = (FLD.field_stations(fx).where(held_out_station())
          .select("station_eoi", *[c.alias(n) for c, n in zip(S.grid_cell_of(F.col("lat"), F.col("lon")), ("row", "col"), strict=True)])
          .where(F.col("row").isNotNull()))
    f = FLD.field(fx, models).where(F.col("value").isNotNull()).select(
        "row", "col", "valid_time", "pollutant", F.col("value").alias("estimate"), "dist_km")
    seen = R.within_bounds(ingest.labels(fx).select("station_eoi", "pollutant", "start_time", "value"))
    seen = fx.spark.sql("SELECT * FROM {r} WHERE start_time BETWEEN (SELECT first_hour FROM {w}) AND (SELECT last_hour FROM {w})",
                        r=seen, w=FLD.hours_around(fx))
    at = seen.join(st, "station_eoi").withColumn("valid_time", F.date_trunc("HOUR", "start_time").cast("timestamp_ntz"))
    return at.join(f, ["row", "col", "valid_time", "pollutant"]).select(
        "station_eoi", "pollutant", "valid_time", "row", "col", "value", "estimate",
        F.round(F.col("estimate") - F.col("value"), 6).alias("error"), "dist_km")


def training_targets(fx: Fixtures) -> DataFrame:
    """M11 + M12 + M16: log target, prior residual and the value 24 h later (self equi
    join on station, pollutant and time + 24 h)."""
    ts = training.training_set(fx).select("station_eoi", "pollutant", "start_time", "value", "prior")
    nxt = ts.select("station_eoi", "pollutant",
                    (F.col("start_time") - F.expr("INTERVAL 24 HOURS")).alias("start_time"),
                    F.col("value").alias("value_next24"))
    t = FE.targets(ts).join(nxt, ["station_eoi", "pollutant", "start_time"], "left")
    return t.select("station_eoi", "pollutant", "start_time", "value",
                    F.round("log_value", 6).alias("log_value"), F.round("residual", 6).alias("residual"),
                    "value_next24")


def satellite_baseline(fx: Fixtures) -> DataFrame:
    """M13 + J15: linear fit of the label on the daily satellite column (NO2 column for NO2, aerosol index for
    PM2.5), and its error metrics, per pollutant; and how many labels have no satellite value that day."""
    ts = training.ungated_rows(fx).select("station_eoi", "pollutant", "start_time", "value",
                                          F.date_trunc("DAY", "start_time").cast("timestamp_ntz").alias("obs_date"))
    sat = satellite.stored_daily(fx).select("station_eoi", "obs_date", *SATELLITE_OF.values())
    rows = written(ts.join(sent_if_small(sat), ["station_eoi", "obs_date"], "left").select("pollutant", "value", FE_sat_col().alias("x")),
                   "satellite-fit")
    rows = R.min_rows_per_group(rows, "pollutant", training.MIN_ROWS)
    coef = rows.groupBy("pollutant").agg(F.regr_slope("value", "x").alias("slope"), F.regr_intercept("value", "x").alias("intercept"),
                                         F.count_if(F.col("x").isNull()).alias("without_satellite"))
    pred = rows.where(F.col("x").isNotNull()).join(F.broadcast(coef), "pollutant")  # one row per pollutant
    pred = pred.withColumn("fit", F.col("intercept") + F.col("slope") * F.col("x"))
    return pred.groupBy("pollutant", "without_satellite").agg(
        F.count(F.lit(1)).alias("n"), *M.error_metrics(F.col("value"), F.col("fit"), prefix="sat_", digits=4))


def FE_sat_col():
    expr = None
    for pol, col in SATELLITE_OF.items():
        expr = (F.when(F.col("pollutant") == pol, F.col(col)) if expr is None
                else expr.when(F.col("pollutant") == pol, F.col(col)))
    return expr


def low_confidence(fx: Fixtures) -> DataFrame:
    """Field values flagged when far from sensors (> 25 km) or when the prior or
    temperature lies outside the range seen in training (per pollutant)."""
    ts = training.training_set(fx)
    rng = ts.groupBy("pollutant").agg(F.min("prior").alias("p_lo"), F.max("prior").alias("p_hi"),
                                      F.min("temp").alias("t_lo"), F.max("temp").alias("t_hi"))
    f = FLD.full_field(fx)
    prior = F.col("prior")
    # one row per pollutant: broadcast of a proven small table
    j = f.join(F.broadcast(rng), "pollutant", "left")
    far = F.coalesce(F.col("dist_km") > FLD.HOTSPOT_KM, F.lit(True))
    out_rng = (~prior.between(F.col("p_lo"), F.col("p_hi"))) | (~F.col("temp").between(F.col("t_lo"), F.col("t_hi")))
    out_rng = F.coalesce(out_rng, F.lit(True))
    return j.select("row", "col", "valid_time", "pollutant", "value", "dist_km",
                    (far | out_rng).alias("low_confidence"),
                    F.concat_ws(",", F.when(far, F.lit("far")), F.when(out_rng, F.lit("out-of-range"))).alias("why"))


def feature_drift(fx: Fixtures) -> DataFrame:
    """AG15: PSI of the prior and of temperature, last 7 days vs the earlier rows."""
    ts = training.training_set(fx)
    cut = fx.spark.sql(f"SELECT *, start_time >= (SELECT max(start_time) FROM {{t}}) - INTERVAL {DRIFT_DAYS} DAYS AS recent "
                       "FROM {t}", t=ts)
    return M.psi_many(cut, "recent", {"prior": ("prior", PRIOR_EDGES), "temp": ("temp", TEMP_EDGES)},
                      ["pollutant"])
