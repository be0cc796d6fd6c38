"""Metrics by 'hour of day' against a numpy rebuild of the offline
analysis: test samples in sequence order, truncated to whole days,
reshaped to (days, 24, steps) and pooled per hour slot."""

import numpy as np
import pytest

from data_sets import SF_CHECK
from demandlake.plans import experiment


def _r2(t, p):
    tot = ((t - t.mean()) ** 2).sum()
    res = ((t - p) ** 2).sum()
    return (1.0 if res == 0 else 0.0) if tot == 0 else 1 - res / tot


def test_errors_by_hour_match_numpy(spark):
    preds = experiment.baseline_predictions(spark, SF_CHECK).toPandas()
    got = {(r["model"], r["hour_of_day"]): r for r in experiment.errors_by_hour(spark, SF_CHECK).collect()}
    for model, g in preds.groupby("model"):
        y = g.pivot(index="seq_no", columns="step", values="y").sort_index().to_numpy()
        p = g.pivot(index="seq_no", columns="step", values="p").sort_index().to_numpy()
        days = len(y) // 24
        y3 = y[:days * 24].reshape(days, 24, -1)
        p3 = p[:days * 24].reshape(days, 24, -1)
        for h in range(24):
            t, q = y3[:, h, :].ravel(), p3[:, h, :].ravel()
            mae = np.mean(np.abs(t - q)); rmse = np.sqrt(np.mean((t - q) ** 2))
            mape = np.mean(np.abs((t - q) / t)); r2 = _r2(t, q)
            r = got[(model, h)]
            assert (r["mae"], r["rmse"], r["mape"], r["r2"]) == pytest.approx((mae, rmse, mape, r2), rel=1e-9)
            assert r["composite"] == pytest.approx((mae + rmse + mape + 1 - r2) / 4, rel=1e-9)
