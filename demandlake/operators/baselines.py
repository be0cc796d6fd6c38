"""Baseline forecasters (H1-H3) in long form.

The three baselines repeat one number over the 24-step horizon, and that
number is a window function of the series at the origin row (computed in
``sequences.windows``): the last input value, the value 72 rows back, or the
mean of the 72 inputs.  No input array is built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Model names as reported.
NAIVE, SEASONAL, MOVING_AVG = "Naive", "Seasonal", "MovingAvg"


def baseline_predictions(win: DataFrame, split: str | None = "test") -> DataFrame:
    """(seq_no, location_id, zone_idx, step, y, model, p) for the three
    baselines; one row per window, step and model."""
    if split:
        win = win.where(F.col("split") == split)
    models = F.array(
        F.struct(F.lit(NAIVE).alias("model"), F.col("last_value").alias("p")),
        F.struct(F.lit(SEASONAL).alias("model"), F.col("value_back").alias("p")),
        F.struct(F.lit(MOVING_AVG).alias("model"), F.col("window_mean").alias("p")))
    steps = win.select("seq_no", "location_id", "zone_idx", "origin_date", "origin_hour",
                       "n_total", "cut2", F.posexplode("y").alias("step", "y"), models.alias("_m"))
    return steps.select("*", F.inline("_m")).drop("_m")


def repeat_forecast(value, horizon: int = 24):
    """The forecast as an array: one value repeated over the horizon."""
    return F.array_repeat(value, horizon)
