import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandlake.operators import metrics, models, serving

EPS = np.finfo(np.float64).eps


def _np_metrics(y, p):
    mae = np.mean(np.abs(y - p)); rmse = math.sqrt(np.mean((y - p) ** 2))
    mape = np.mean(np.abs(y - p) / np.maximum(np.abs(y), EPS))
    r2s = []
    for k in range(y.shape[1]):
        res = ((y[:, k] - p[:, k]) ** 2).sum(); tot = ((y[:, k] - y[:, k].mean()) ** 2).sum()
        r2s.append((1.0 if res == 0 else 0.0) if tot == 0 else 1 - res / tot)
    r2 = float(np.mean(r2s))
    return mae, rmse, mape, r2, (mae + rmse + mape + 1 - r2) / 4


def test_evaluate_matches_numpy_including_constant_step(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(1, 20, (40, 3)).astype(float); y[:, 2] = 5.0   # constant target column
    p = y + rng.normal(0, 2, y.shape); p[:, 2] = 5.0                  # exact there -> R2 1
    rows = [(i, k, float(y[i, k]), float(p[i, k]), "m") for i in range(40) for k in range(3)]
    df = spark.createDataFrame(rows, "seq_no long, step int, y double, p double, model string")
    r = metrics.evaluate(df).collect()[0]
    mae, rmse, mape, r2, comp = _np_metrics(y, p)
    assert (r["mae"], r["rmse"], r["mape"], r["r2"], r["composite"]) == pytest.approx((mae, rmse, mape, r2, comp))


def test_mape_zero_target_is_huge(spark):
    df = spark.createDataFrame([(0, 0, 0.0, 1.0, "m"), (0, 1, 2.0, 2.0, "m")],
                               "seq_no long, step int, y double, p double, model string")
    assert metrics.evaluate(df).collect()[0]["mape"] > 1e15


def test_pooled_mape_without_eps_is_infinite(spark):
    df = spark.createDataFrame([("m", 0, 0.0, 1.0), ("m", 0, 2.0, 2.0)], "model string, h int, y double, p double")
    assert math.isinf(metrics.evaluate_pooled(df, ["model", "h"]).collect()[0]["mape"])


def _series(spark):
    rows = []
    for zone, hours in (("A", list(range(0, 100))), ("B", [5, 6, 9])):
        for i, h in enumerate(hours):
            t = dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
            rows.append((t.date(), t.hour, zone, i, float(i), None if i == 1 else 2.0))
    df = spark.createDataFrame(rows, "date date, hour int, location_id string, time_idx long, f double, g double")
    return serving.series_ts(df)


def test_asof_status_padding_and_imputation(spark):
    s = _series(spark)
    req = spark.createDataFrame([
        (1, "B", dt.datetime(2024, 1, 1, 7, 30)),   # between B's rows -> row at 06:00 (idx 1)
        (2, "B", dt.datetime(2024, 1, 1, 4, 0)),    # before first row
        (3, "Z", dt.datetime(2024, 1, 1, 7, 0)),    # unknown zone
        (4, "B", dt.datetime(2024, 1, 3, 0, 0)),    # after the last row -> last row
        (5, "A", dt.datetime(2024, 1, 4, 3, 59)),   # 75 h -> idx 75, full window
    ], "request_id long, location_id string, target_ts timestamp_ntz")
    st = {r["request_id"]: (r["status"], r["asof_idx"]) for r in serving.resolve_requests(s, req).collect()}
    assert st == {1: ("ok", 1), 2: ("no_history", None), 3: ("no_zone", None), 4: ("ok", 2), 5: ("ok", 75)}
    w = serving.serving_windows(s, req, feature_cols=("f", "g"))
    r1 = sorted(w.where(F.col("request_id") == 1).collect(), key=lambda r: r["pos"])
    assert len(r1) == 72 and sum(r["padded"] for r in r1) == 70
    assert r1[0]["f"] == pytest.approx(1.0)        # padding = zone mean of f over all 3 rows
    assert r1[70]["f"] == 0.0 and r1[71]["f"] == 1.0
    assert r1[71]["g"] == 2.0                      # missing g -> zone mean (2.0)
    r5 = sorted(w.where(F.col("request_id") == 5).collect(), key=lambda r: r["pos"])
    assert [r["f"] for r in r5] == [float(i) for i in range(4, 76)]


def test_post_process_fixture(spark):
    # scaler fitted on 0, 10, 20: mean 10, population std 8.16496580927726
    std = float(np.std([0, 10, 20]))
    df = spark.createDataFrame([([-2.4, 3.3, 0.0, 0.05],)], "p array<double>")
    ceil = serving.post_process(df, "p", (10.0, std), "ceil").collect()[0]["p"]
    even = serving.post_process(df, "p", (10.0, std), "half_even").collect()[0]["p"]
    assert ceil == [0.0, 37.0, 10.0, 11.0]
    assert even == [0.0, 37.0, 10.0, 10.0]


def test_forecast_hours_and_text(spark):
    from demandlake.functions import text
    df = spark.createDataFrame([(7, [3.0, 4.0], [1.234, 5.0], dt.datetime(2024, 1, 31, 23, 0))],
                               "h int, d array<double>, c array<double>, target_ts timestamp_ntz")
    r = df.select(text.list_to_text(F.col("d")).alias("t"),
                  text.format_forecast(F.col("h"), F.col("d"), F.col("c")).alias("m")).collect()[0]
    assert r["t"] == "[3, 4]"
    lines = r["m"].split("\n")
    assert lines[0].endswith("23:00 - \U0001F697 3 поездок, \U0001F4B0 1.23 $ per mile")
    assert "00:00" in lines[1]
    fh = serving.forecast_hours(df.withColumnRenamed("d", "forecast")).collect()
    assert [(r["date"], r["hour"]) for r in fh] == [(dt.date(2024, 1, 31), 23), (dt.date(2024, 2, 1), 0)]


def _asked_series(spark):
    rows = [("A", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), i, float(i % 7)) for i in range(100)]
    series = spark.createDataFrame(rows, "location_id string, ts timestamp_ntz, time_idx int, trips_count double")
    asked = [(i, "A", dt.datetime(2024, 1, 1 + i % 4, 5), ["m", "gone", None][i % 3]) for i in range(60)] + [(60, "B", dt.datetime(2024, 1, 1), "m")]
    return series, spark.createDataFrame(asked, "request_id long, location_id string, target_ts timestamp_ntz, model string")


def test_windows_are_scored_once_whatever_asks_for_them(spark):
    series, req = _asked_series(spark)
    scored = spark.sparkContext.accumulator(0)

    def last(x):
        scored.add(len(x))
        return np.repeat(x[:, -1:, 0], 24, axis=1)
    resolved = serving.resolve_requests(series, req)
    out = serving.request_forecasts(series, resolved, lambda x, keys: models.score_sequences(x, last, keys, n_features=1),
                                    by=("model",), feature_cols=["trips_count"]).collect()
    assert scored.value == 12                                    # four hours, three names; not 60 requests
    assert {r["request_id"]: r["forecast"][0] for r in out} == {i: float((24 * (i % 4) + 5) % 7) for i in range(60)}
    arrays = serving.serving_arrays(series, req, feature_cols=["trips_count"], resolved=resolved)
    each = models.score_sequences(arrays, lambda x: np.repeat(x[:, -1:, 0], 24, axis=1), n_features=1).collect()
    assert sorted((r["request_id"], r["forecast"]) for r in out) == sorted((r["request_id"], r["forecast"]) for r in each)


def test_equal_forecasts_are_priced_once(spark, monkeypatch):
    seen = []

    def priced(model, rows, numeric):
        seen.append(rows.count())
        return rows.withColumn("prediction", F.col("trips_count") + F.col("hour"))
    monkeypatch.setattr(models, "predict_cost", priced)
    at = dt.datetime(2024, 1, 1, 22)
    rows = [(i, "A", at, [float(i % 2)] * 24, [0.0, 5.0, 5.0][i % 3]) for i in range(30)]
    fc = spark.createDataFrame([*rows, rows[1]], "request_id long, location_id string, target_ts timestamp_ntz, forecast array<double>, cost double")
    weather = spark.createDataFrame([], "date date, hour int, temp double, prcp double, wspd double")
    got = {r["request_id"]: r["trip_costs"] for r in models.price_forecast(fc, None, weather, ()).collect()}
    assert seen == [48]                                          # two forecasts of 24 hours; not 21 rows of 24
    hours = [float((22 + k) % 24) for k in range(24)]
    want = {i: [h + i % 2 for h in hours] for i in range(30) if i % 3}
    assert got == want | {1: [c for c in want[1] for _ in range(2)]}     # a row given twice is priced twice, as before
