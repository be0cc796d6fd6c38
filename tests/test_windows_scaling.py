"""Windows, split, scaler and imputation against a brute-force numpy
rebuild of the flattened-window computation on a small series."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandlake.operators import scaling, sequences

PAST, FUT = 72, 24


def _frame(spark):
    rng = np.random.default_rng(3)
    rows = []
    for zone, n in (("A", 180), ("B", 130), ("C", 60), ("D", 96)):
        for i in range(n):
            t = dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)
            temp = None if (i % 7 == 3) else float(rng.normal(5, 2))
            rows.append((t.date(), t.hour, zone, int(rng.integers(0, 30)), float(rng.normal()), temp, i))
    return rows, spark.createDataFrame(
        rows, "date date, hour int, location_id string, trips_count long, f1 double, temp double, time_idx long")


def _brute(rows, feats):
    zones = sorted({r[2] for r in rows})
    X, Y, reg = [], [], []
    for z in zones:
        sub = [r for r in rows if r[2] == z]
        arr = np.array([[np.nan if v is None else v for v in (r[3], r[4], r[5])] for r in sub], dtype=float)
        arr = arr[:, [("trips_count", "f1", "temp").index(f) for f in feats]]
        trips = np.array([r[3] for r in sub], dtype=float)
        for i in range(PAST, len(sub) - FUT + 1):
            X.append(arr[i - PAST:i]); Y.append(trips[i:i + FUT]); reg.append(z)
    return np.array(X), np.array(Y), reg


def test_window_count_and_split(spark):
    rows, df = _frame(spark)
    win = sequences.windows(df).collect()
    X, Y, reg = _brute(rows, ("trips_count",))
    assert len(win) == len(X) == (180 - 95) + (130 - 95) + 0 + (96 - 95)
    n = len(X)
    cut1, cut2 = int(0.6 * n), int(0.8 * n)
    by_seq = {r["seq_no"]: r for r in win}
    assert sorted(by_seq) == list(range(n))
    for s in range(n):
        r = by_seq[s]
        assert r["location_id"] == reg[s]
        assert r["split"] == ("train" if s < cut1 else "val" if s < cut2 else "test")
        np.testing.assert_allclose(r["y"], Y[s])
        assert r["last_value"] == X[s][-1, 0] and r["value_back"] == X[s][0, 0]
        assert abs(r["window_mean"] - X[s][:, 0].mean()) < 1e-9


def test_scaler_equals_flattened_training_windows(spark):
    rows, df = _frame(spark)
    feats = ("trips_count", "f1", "temp")
    params = {r["feature"]: r for r in scaling.fit_scaler(
        scaling.long_form(scaling.window_weights(df), feats)).collect()}
    X, Y, _ = _brute(rows, feats)
    cut1 = int(0.6 * len(X))
    flat = X[:cut1].reshape(-1, len(feats))
    means = np.nan_to_num(np.nanmean(flat, axis=0))
    filled = np.where(np.isnan(flat), means, flat)
    std = filled.std(axis=0)
    std[std == 0] = 1.0
    for j, f in enumerate(feats):
        assert params[f]["n"] == flat.shape[0]
        assert params[f]["mean"] == pytest.approx(means[j], rel=1e-10)
        assert params[f]["scale"] == pytest.approx(std[j], rel=1e-9)
    y = Y[:cut1].reshape(-1)
    assert params["y"]["mean"] == pytest.approx(y.mean(), rel=1e-10)
    assert params["y"]["scale"] == pytest.approx(y.std(), rel=1e-9)


def test_scaler_merge_of_parts_equals_whole(spark):
    _, df = _frame(spark)
    w = scaling.window_weights(df)
    feats = ("trips_count", "f1", "temp")
    whole = {r["feature"]: r for r in scaling.fit_scaler(scaling.long_form(w, feats)).collect()}
    a = scaling.fit_scaler(scaling.long_form(w.where(F.col("hour") < 12), feats))
    b = scaling.fit_scaler(scaling.long_form(w.where(F.col("hour") >= 12), feats))
    merged = {r["feature"]: r for r in scaling.merge_scaler(a, b).collect()}
    for f in (*feats, "y"):
        assert merged[f]["n"] == whole[f]["n"]
        assert merged[f]["mean"] == pytest.approx(whole[f]["mean"], rel=1e-9, abs=1e-12)
        assert merged[f]["scale"] == pytest.approx(whole[f]["scale"], rel=1e-9)


def test_constant_feature_scale_is_one(spark):
    df = spark.createDataFrame([("A", i, 0.7, 3) for i in range(200)],
                               "location_id string, time_idx long, c double, trips_count long")
    p = {r["feature"]: r for r in scaling.fit_scaler(
        scaling.long_form(scaling.window_weights(df), ("c",))).collect()}
    assert p["c"]["scale"] == 1.0 and p["c"]["mean"] == pytest.approx(0.7)
    assert p["y"]["scale"] == 1.0


def test_day_block_truncation(spark):
    df = spark.createDataFrame([(i, 10, 0, 3 * 24 + 5) for i in range(3 * 24 + 5)],
                               "seq_no long, cut2 long, x int, n_total long")
    df = df.where(F.col("seq_no") >= 10)
    out = sequences.day_block(df).collect()
    assert len(out) == 48 and max(r["sample_no"] for r in out) == 47
    assert {r["hour_of_day"] for r in out} == set(range(24))
