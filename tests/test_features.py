import datetime as dt

import numpy as np
import pandas as pd

from demandlake.operators import features as feat


def _series(spark, counts, zone="A", start=dt.datetime(2024, 1, 1), gaps=()):
    rows, t = [], start
    for i, c in enumerate(counts):
        t = start + dt.timedelta(hours=i + sum(1 for g in gaps if g <= i))
        rows.append((t.date(), t.hour, zone, c))
    return rows


def test_lags_rolling_time_idx_match_pandas(spark):
    rng = np.random.default_rng(7)
    a = _series(spark, rng.integers(0, 20, 200).tolist(), "A", gaps=(5, 40))
    b = _series(spark, rng.integers(0, 5, 30).tolist(), "B")
    df = spark.createDataFrame(a + b, "date date, hour int, location_id string, trips_count long")
    out = feat.with_time_idx(feat.with_rolling(feat.with_lags(df))).toPandas()
    out = out.sort_values(["location_id", "date", "hour"]).reset_index(drop=True)
    pdf = pd.DataFrame(a + b, columns=["date", "hour", "location_id", "trips_count"])
    pdf = pdf.sort_values(["location_id", "date", "hour"]).reset_index(drop=True)
    g = pdf.groupby("location_id")["trips_count"]
    for k in (1, 24, 168):
        np.testing.assert_allclose(out[f"lag_{k}h"], g.shift(k).fillna(0))
    roll = g.rolling(168, min_periods=1)
    np.testing.assert_allclose(out["roll_168h_mean"], roll.mean().reset_index(level=0, drop=True), rtol=1e-12)
    np.testing.assert_allclose(out["roll_168h_median"], roll.median().reset_index(level=0, drop=True))
    np.testing.assert_allclose(out["roll_168h_std"], roll.std().reset_index(level=0, drop=True).fillna(0),
                               rtol=1e-9, atol=1e-12)
    np.testing.assert_array_equal(out["time_idx"], g.cumcount())


def test_bfill_lag_stays_in_zone(spark):
    rows = _series(spark, [5, 6, 7], "A") + _series(spark, [1, 2], "B")
    df = spark.createDataFrame(rows, "date date, hour int, location_id string, trips_count long")
    out = {(r["location_id"], r["hour"]): r["lag_1h"]
           for r in feat.with_lags(df, lags=(1,), fill="bfill").collect()}
    assert out[("A", 0)] == 5.0 and out[("A", 1)] == 5.0 and out[("A", 2)] == 6.0
    assert out[("B", 0)] == 1.0 and out[("B", 1)] == 1.0


def test_row_adjacency_matches_whole_table_shift(spark):
    # Jan 14 (Sunday) -> Jan 15 MLK -> Jan 16; zones A and B, sparse hours
    rows = [(dt.date(2024, 1, 14), 22, "A", 1), (dt.date(2024, 1, 14), 23, "B", 1),
            (dt.date(2024, 1, 15), 0, "A", 1), (dt.date(2024, 1, 15), 5, "B", 1),
            (dt.date(2024, 1, 16), 1, "A", 1)]
    df = spark.createDataFrame(rows, "date date, hour int, location_id string, trips_count long")
    out = {(r["date"], r["hour"], r["location_id"]): (r["is_pre_holiday"], r["is_post_holiday"])
           for r in feat.with_row_adjacency(df).collect()}
    assert out[(dt.date(2024, 1, 14), 22, "A")] == (0, 0)
    assert out[(dt.date(2024, 1, 14), 23, "B")] == (1, 0)   # next row is on the holiday
    assert out[(dt.date(2024, 1, 15), 0, "A")] == (1, 0)    # same-date neighbours
    assert out[(dt.date(2024, 1, 15), 5, "B")] == (0, 1)
    assert out[(dt.date(2024, 1, 16), 1, "A")] == (0, 1)    # last row: no next row
