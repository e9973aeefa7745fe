"""

Each value is ``(spark, sf_dir) -> DataFrame``; the fixture views are built from the
parquet tables in ``sf_dir`` inside the call, and the caller's session settings are
left alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from airfill.operators import readings as R
from airfill.plans import context, evaluation, field, ingest, satellite, training
from airfill.sources import readers
from airfill.streaming import field as SF
from airfill.streaming import readings as ST
from airfill.sources.fixtures import Fixtures

Query = Callable[[SparkSession, str], DataFrame]


def _on_fixtures(fn) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Fixtures(spark, sf_dir))
    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


QUERIES: dict[str, Query] = {
    "station_metadata": _on_fixtures(lambda fx: R.station_metadata(fx.station_points)),
    "q1_labels": _on_fixtures(ingest.labels),
    "labels_from_files": _on_fixtures(ingest.labels_from_files),
    "q2_station_features": _on_fixtures(ingest.station_features),
    "asof_join": _on_fixtures(training.feature_view),
    "q4_training_set": _on_fixtures(training.training_set),
    "prior_metrics": _on_fixtures(training.prior_report),
    "label_p99": _on_fixtures(training.label_p99),
    "mae_by_distance": _on_fixtures(training.mae_by_distance),
    "calibration": _on_fixtures(training.calibration),
    "error_map": _on_fixtures(training.error_map),
    "station_state": _on_fixtures(ingest.station_state),
    "cells_needed": _on_fixtures(ingest.cells_needed),
    "days_to_do": _on_fixtures(ingest.days_to_do),
    "packed_pixels": _on_fixtures(satellite.packed_pixels),
    "station_boxes": _on_fixtures(satellite.station_boxes),
    "granule_search": _on_fixtures(lambda fx: satellite.search_granules(fx.granules, satellite.station_boxes(fx))),
    "granules_of_a_day": _on_fixtures(satellite.granules_of_a_day),
    "nearest_pixel": _on_fixtures(lambda fx: satellite.nearest_pixels(fx).select(
        "station_eoi", "granule", "product", "obs_date", "pixel_id", F.round("value", 12).alias("value"),
        F.round("dist_km", 6).alias("dist_km"))),
    "q3_satellite_daily": _on_fixtures(satellite.satellite_daily),
    "grid_distance": _on_fixtures(field.grid_distance),
    "field_axis": _on_fixtures(field.field_axis),
    "q6_field": _on_fixtures(field.field),
    "q6_field_model": _on_fixtures(evaluation.model_field),
    "field_refresh": _on_fixtures(SF.refreshed_field),
    "grid_scores": _on_fixtures(evaluation.grid_scores),
    "hotspots": _on_fixtures(field.hotspots),
    "point_report": _on_fixtures(field.point_report),
    "place_report": _on_fixtures(lambda fx: field.place_report(fx, fx.places, "place_id")),
    "mosaic": _on_fixtures(field.mosaic),
    "fold_assignment": _on_fixtures(evaluation.fold_assignment),
    "spatial_folds": _on_fixtures(evaluation.spatial_folds),
    "idw_baseline": _on_fixtures(evaluation.idw_report),
    "training_targets": _on_fixtures(evaluation.training_targets),
    "satellite_baseline": _on_fixtures(evaluation.satellite_baseline),
    "low_confidence": _on_fixtures(evaluation.low_confidence),
    "feature_drift": _on_fixtures(evaluation.feature_drift),
    "gbt_oof": _on_fixtures(evaluation.gbt_report),
    "model_mae_by_distance": _on_fixtures(evaluation.model_mae_by_distance),
    "feature_importance": _on_fixtures(evaluation.importance_and_registry),
    "stream_dedupe": _on_fixtures(lambda fx: ST.dedupe_stream(fx.spark, fx.stream_readings)),
    "stream_latest": _on_fixtures(lambda fx: ST.latest_stream(fx.spark, fx.stream_readings)),
    "stream_hourly": _on_fixtures(lambda fx: ST.hourly_stream(fx.spark, fx.stream_readings)),
    "stream_sliding": _on_fixtures(lambda fx: ST.sliding_stream(fx.spark, fx.stream_readings)),
    "self_score": _on_fixtures(lambda fx: ST.self_score_stream(fx.spark, fx.predictions, fx.stream_readings)),
    "stream_enriched": _on_fixtures(lambda fx: ST.enriched_stream(
        fx.spark, fx.stream_readings, ingest.station_features(fx), training.FEATURE_COLS)),
    "density_hex": _on_fixtures(training.density_hex),
    "upsert_labels": _on_fixtures(ingest.upsert_labels),
    "labels_not_stored": _on_fixtures(ingest.labels_not_stored),
    "label_counts": _on_fixtures(ingest.label_counts),
    "live_error": _on_fixtures(lambda fx: ST.live_error(
        ST.self_score_stream(fx.spark, fx.predictions, fx.stream_readings))),
    "rolling_error": _on_fixtures(lambda fx: ST.rolling_error(fx.spark, fx.predictions, fx.stream_readings)),
    "granule_footprints": _on_fixtures(satellite.granule_footprints),
    "cell_context": _on_fixtures(context.cell_context),
    "station_context": _on_fixtures(context.station_context),
    "population_by_distance": _on_fixtures(context.population_by_distance),
    "cell_series": _on_fixtures(context.cell_series),
    "station_sample": _on_fixtures(context.station_sample),
    "first_stations": _on_fixtures(context.first_stations),
    "extended_features": _on_fixtures(context.extended_features),
    "station_file": _on_fixtures(context.station_file),
    "hourly_lists": _on_fixtures(context.hourly_lists),
    "hourly_json": _on_fixtures(lambda fx: readers.explode_hourly(
        fx.hourly_payloads, "payload", {"pm2_5": "cams_pm25", "nitrogen_dioxide": "cams_no2"},
        keep=["station_no", "lat", "lon"])),
}
