"""Offline evaluation job: features -> windows -> split -> scaler ->
baselines -> metrics (the notebooks' experiment), bound to driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlake.operators import baselines, metrics, scaling, sequences
from demandlake.operators.features import SEQ_FEATURES
from demandlake.plans import daily


TARGET, ROW = "target", "row_no"


def model_rows(features: DataFrame, params: dict) -> DataFrame:
    """Features imputed and scaled for a model, beside the raw target and row number."""
    raw = features.withColumns({TARGET: F.col("trips_count").cast("double"), ROW: F.col("time_idx")})
    return scaling.transform(scaling.impute(raw, params, SEQ_FEATURES), params, SEQ_FEATURES)


def feature_windows(spark: SparkSession, sf_dir: str, features: DataFrame | None = None) -> DataFrame:
    f = features if features is not None else daily.stable_features(spark, sf_dir)
    return sequences.windows(f)


def scaler(spark: SparkSession, sf_dir: str, split: str = "train",
           features: DataFrame | None = None, feature_cols=SEQ_FEATURES) -> DataFrame:
    f = features if features is not None else daily.stable_features(spark, sf_dir)
    long = scaling.long_form(scaling.window_weights(f, split=split), feature_cols)
    return scaling.fit_scaler(long)


def scaler_merged(spark: SparkSession, sf_dir: str, cut_date: str = "2024-01-15") -> DataFrame:
    """The same fit as ``scaler`` computed as two partial fits over two date
    ranges and merged (G6): partial results combine exactly."""
    w = scaling.window_weights(daily.stable_features(spark, sf_dir), split="train")
    early = w.where(F.col("date") < F.to_date(F.lit(cut_date)))
    late = w.where(F.col("date") >= F.to_date(F.lit(cut_date)))
    a = scaling.fit_scaler(scaling.long_form(early, SEQ_FEATURES))
    b = scaling.fit_scaler(scaling.long_form(late, SEQ_FEATURES))
    return scaling.merge_scaler(a, b)


def scaled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = daily.stable_features(spark, sf_dir)
    params = scaler(spark, sf_dir, features=f)
    p = scaling.to_dict(params)
    out = scaling.transform(scaling.impute(f, p, SEQ_FEATURES), p, SEQ_FEATURES)
    return out.select("date", "hour", "location_id", *SEQ_FEATURES)


def baseline_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baselines.baseline_predictions(feature_windows(spark, sf_dir))


def model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.model_table(metrics.evaluate(baseline_predictions(spark, sf_dir)))


def errors_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = sequences.day_block(baseline_predictions(spark, sf_dir))
    return metrics.evaluate_pooled(p, ["model", "hour_of_day"])


def errors_by_origin_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled metrics by the real clock hour of the window origin."""
    return metrics.evaluate_pooled(baseline_predictions(spark, sf_dir), ["model", "origin_hour"])


def errors_by_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.mae_by(baseline_predictions(spark, sf_dir), ["model", "location_id"])


def error_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.mae_by(baseline_predictions(spark, sf_dir), ["model", "location_id", "step"])
