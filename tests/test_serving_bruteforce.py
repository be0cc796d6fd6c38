"""Serving windows against a plain pandas rebuild of the per-request
procedure: rows of the zone at or before the target, last 72, missing
values and left padding from the zone's mean row."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from data_sets import SF_SMALL
from demandlake.operators import serving
from demandlake.operators.features import SEQ_FEATURES
from demandlake.plans import daily, requests


def test_serving_windows_match_pandas(spark):
    feats = daily.feature_table(spark, SF_SMALL)
    series = serving.series_ts(feats)
    req = requests.driver_requests(spark, SF_SMALL)
    got = serving.serving_windows(series, req).toPandas()
    s = series.toPandas()
    s[list(SEQ_FEATURES)] = s[list(SEQ_FEATURES)].astype("float64")
    r = req.toPandas()
    checked = 0
    for _, q in r.iterrows():
        sub = s[s["location_id"] == q["location_id"]].sort_values("ts")
        hist = sub[sub["ts"] <= q["target_ts"]]
        mine = got[got["request_id"] == q["request_id"]].sort_values("pos")
        if sub.empty or hist.empty:
            assert mine.empty
            continue
        means = sub[list(SEQ_FEATURES)].mean(skipna=True).to_numpy()
        x = hist[list(SEQ_FEATURES)].to_numpy()
        x = np.where(np.isnan(x), means, x)
        if len(x) < 72:
            x = np.vstack([np.tile(means, (72 - len(x), 1)), x])
        else:
            x = x[-72:]
        np.testing.assert_allclose(mine[list(SEQ_FEATURES)].to_numpy(), x, rtol=1e-12, atol=1e-12)
        checked += 1
    assert checked > 50


def test_matrices_are_cut_from_blocks_for_wanted_rows_only(spark):
    """Blocks shorter than a matrix, at their edges, with gaps, padding and rows asked for twice."""
    rng = np.random.default_rng(3)
    rows = [(z, i, None if rng.random() < 0.2 else float(rng.integers(0, 50)), float(i)) for z, n in (("a", 40), ("b", 7)) for i in range(n)]
    series = spark.createDataFrame(rows, "location_id string, time_idx long, u double, v double")
    asked = [("a", 0), ("a", 4), ("a", 5), ("a", 39), ("a", 39), ("b", 6), ("c", 1)]
    wanted = spark.createDataFrame(asked, "location_id string, asof_idx long")
    params = {"u": (10.0, 4.0)}
    whole = pd.DataFrame(rows, columns=["z", "i", "u", "v"])
    for upto in (False, True):
        got = serving.window_matrices(series, wanted, params, ["u", "v"], past=12, upto_target=upto, block=5).collect()
        assert sorted((r["location_id"], r["asof_idx"]) for r in got) == sorted(set(asked) - {("c", 1)})
        for r in got:
            zone = whole[(whole["z"] == r["location_id"]) & ((whole["i"] <= r["asof_idx"]) | (not upto))]
            mean = zone[["u", "v"]].mean()
            held = zone[(zone["i"] <= r["asof_idx"]) & (zone["i"] > r["asof_idx"] - 12)][["u", "v"]].fillna(mean)
            front = pd.DataFrame([mean] * (12 - len(held)), columns=["u", "v"])
            want = pd.concat([x for x in (front, held) if len(x)])
            want["u"] = (want["u"] - 10.0) / 4.0
            assert r["n_padded"] == len(front)
            np.testing.assert_allclose(np.array(r["x"], dtype=float), want.to_numpy(dtype=float), rtol=1e-12, atol=1e-12, equal_nan=True)
