"""Periodic refit on the newest data (H8, G6): the batch retraining job.

Windows of the new data are split 80/20 (train/val, no test); the scaler of
the previous version is updated with the new training windows (an
incremental merge of (n, mean, m2)), the linear multi-output model is
refitted on the scaled windows, and everything is written to a new version
folder under the model directory.  The caller records the returned path
once the write has succeeded, so a failed run leaves the previous model in
place.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from demandlake.operators import lagged, scaling
from demandlake.operators.features import SEQ_FEATURES
from demandlake.plans import experiment

RETRAIN_FRACTIONS = (0.8, 1.0)


def refit(spark: SparkSession, features: DataFrame, model_dir: str,
          previous: DataFrame | None = None) -> str:
    """Fit (or update) scaler and linear model; returns the version path."""
    w = scaling.window_weights(features, fractions=RETRAIN_FRACTIONS, split="train")
    fresh = scaling.fit_scaler(scaling.long_form(w, SEQ_FEATURES))
    params = scaling.merge_scaler(previous, fresh) if previous is not None else fresh
    p = scaling.to_dict(params)
    coef, intercept = lagged.fit(experiment.model_rows(features, p), SEQ_FEATURES, experiment.TARGET, RETRAIN_FRACTIONS,
                                 idx=experiment.ROW)
    path = os.path.join(model_dir, f"v={uuid.uuid4().hex[:12]}")
    params.write.mode("overwrite").parquet(os.path.join(path, "scaler"))
    rows = [(int(i), [float(v) for v in coef[:, i]], float(intercept[i])) for i in range(coef.shape[1])]
    spark.createDataFrame(rows, "step int, coef array<double>, intercept double") \
        .write.mode("overwrite").parquet(os.path.join(path, "linear"))
    return path


def load(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    lin = sorted(spark.read.parquet(os.path.join(path, "linear")).collect(), key=lambda r: r["step"])
    coef = np.array([r["coef"] for r in lin]).T
    return spark.read.parquet(os.path.join(path, "scaler")), coef, np.array([r["intercept"] for r in lin])
