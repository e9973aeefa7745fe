"""Model operators on ``pyspark.ml`` (M5-M8, M10, M13, M14, SK3, SK4).

Training runs on the cluster: each fold fit is a distributed ``GBTRegressor`` job; the
driver only sequences the k fits and never holds rows. Missing values are imputed with
a missing-flag column because Spark's trees reject NaN (trap T7).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airfill.session import written

# Regressor settings (a level-wise stand-in for the source's leaf-wise booster)
GBT_PARAMS = {"maxIter": 20, "maxDepth": 5, "stepSize": 0.1, "maxBins": 64, "seed": 42,
              "subsamplingRate": 1.0}
VALIDATION_SHARE = 10  # one station in ten held out for early stopping (T8)


def gbt_pipeline(features: Sequence[str], label: str = "value", params: dict | None = None,
                 validation_col: str | None = None, impute: Sequence[str] = ()) -> Pipeline:
    """Imputer (median, for the nullable columns) -> VectorAssembler -> GBTRegressor."""
    params = {**GBT_PARAMS, **(params or {})}
    stages = []
    cols = list(features)
    if impute:
        outs = [f"{c}__imp" for c in impute]
        stages.append(Imputer(inputCols=list(impute), outputCols=outs, strategy="median"))
        cols = [f"{c}__imp" if c in impute else c for c in cols]
    stages.append(VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep"))
    gbt = GBTRegressor(featuresCol="features", labelCol=label, predictionCol="prediction", **params)
    if validation_col:
        gbt = gbt.setValidationIndicatorCol(validation_col)
    stages.append(gbt)
    return Pipeline(stages=stages)


def with_missing_flags(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """``<c>_missing`` 0/1 columns next to nullable inputs."""
    flags = {f"{c}_missing": F.when(F.col(c).isNull(), 1.0).otherwise(0.0) for c in cols}
    return df.withColumns(flags), list(flags)


def validation_flag(group: str) -> F.Column:
    """Station-hash validation split for early stopping (whole stations)."""
    return (F.pmod(F.xxhash64(F.col(group)), F.lit(VALIDATION_SHARE)) == 0)


def out_of_fold(df: DataFrame, folds: DataFrame, features: Sequence[str], group: str = "station_eoi",
                label: str = "value", keys: Sequence[str] = (), params: dict | None = None,
                impute: Sequence[str] = ()) -> DataFrame:
    """M5: leave-groups-out predictions (None without folds). ``folds`` has (group, fold); for each fold i the
    model is fit on the other folds and scores fold i. Output: keys, label, prediction.

    The rows with their fold are written once, a folder per fold: a fit reads the folders it needs."""
    joined = df.join(folds.select(group, "fold"), group, "inner")
    data = written(joined.select(*dict.fromkeys([*keys, group, label, *features, "fold"])), "fold-rows", by=["fold"])
    k = data.agg(F.max("fold")).first()[0]
    parts = []
    for i in range(int(k) + 1 if k is not None else 0):
        train = data.filter(F.col("fold") != i)
        test = data.filter(F.col("fold") == i)
        model = fit(train, features, group, label, params, impute)
        parts.append(model.transform(test).select(*keys, group, label, "prediction"))
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


def fit(train: DataFrame, features: Sequence[str], group: str = "station_eoi", label: str = "value",
        params: dict | None = None, impute: Sequence[str] = ()) -> PipelineModel:
    """M6 / M7: fit the pipeline; a station-hash validation split drives early stopping
    when it is non-empty on both sides (T8)."""
    t = train.withColumn("_is_val", validation_flag(group))
    has_val = (not t.filter(F.col("_is_val")).isEmpty()) and (not t.filter(~F.col("_is_val")).isEmpty())
    pipe = gbt_pipeline(features, label, params, "_is_val" if has_val else None, impute)
    return pipe.fit(t)


def score(df: DataFrame, model: PipelineModel | None, prior: str) -> DataFrame:
    """M8: model prediction clamped at 0, or the prior when there is no model;
    ``status`` says which."""
    if model is None:
        return df.withColumns({"prediction": F.col(prior), "status": F.lit("cams-prior")})
    out = model.transform(df)
    return out.withColumns({"prediction": F.greatest(F.col("prediction"), F.lit(0.0)),
                            "status": F.lit("model")})


def feature_importance(spark: SparkSession, model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """Importance per input feature (from the fitted trees; a few dozen values)."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, imp)], "feature string, importance double")


def save_model(model: PipelineModel, metrics: DataFrame, root: str, pollutant: str) -> str:
    """SK3: save as ``<root>/air_quality_<pol>/v<N>`` (N = next version) and append a
    metrics row (pollutant, version, path, metrics...) to ``<root>/metrics``."""
    spark = metrics.sparkSession
    mroot = f"{root}/metrics"
    prev = None
    if _exists(spark, mroot):
        prev = spark.read.parquet(mroot).filter(F.col("pollutant") == pollutant).agg(F.max("version")).first()[0]
    version = int(prev or 0) + 1
    path = f"{root}/air_quality_{pollutant}/v{version}"
    model.write().save(path)  # an existing version is an error, never overwritten
    (metrics.withColumns({"pollutant": F.lit(pollutant), "version": F.lit(version), "path": F.lit(path)})
            .write.mode("append").parquet(mroot))
    return path


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def latest_models(spark: SparkSession, root: str) -> DataFrame:
    """SK4: newest version per pollutant from the metrics table (``max_by``)."""
    m = spark.read.parquet(f"{root}/metrics")
    return m.groupBy("pollutant").agg(F.max("version").alias("version"),
                                      F.max_by("path", "version").alias("path"))
