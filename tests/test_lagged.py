"""The linear model from lag products, against least squares over gathered windows."""

import numpy as np
import pytest

from demandlake.operators import lagged

PAST, FUTURE = 72, 24


def series(spark, sizes):
    rng = np.random.default_rng(11)
    rows = []
    for zone, n in sizes.items():
        y = rng.normal(size=n).cumsum()
        rows += [(zone, i, float(np.sin(i / 5) + rng.normal()), 2.5, float(y[i])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "location_id string, time_idx long, f double, constant double, y double")


def gathered(rows, sizes):
    """Flattened windows and targets in zone and time order."""
    xs, ys, keys = [], [], []
    for zone in sorted(sizes):
        z = np.array([r[2:] for r in rows if r[0] == zone]).reshape(-1, 3)
        for o in range(PAST, len(z) - FUTURE + 1):
            xs.append(z[o - PAST:o].ravel())
            ys.append(z[o:o + FUTURE, 2])
            keys.append((zone, o))
    return np.array(xs), np.array(ys), keys


# the cut of the training windows falls into zone B; C is too short for a window, D has one
SIZES = {"A": 700, "B": 400, "C": 60, "D": 96}


@pytest.mark.parametrize("block", [4096, 97])
def test_fit_predict_and_residuals_equal_gathered_windows(spark, monkeypatch, block):
    monkeypatch.setattr(lagged, "BLOCK", block)
    monkeypatch.setattr(lagged, "BUNCH", 1)
    rows, df = series(spark, SIZES)
    features = ["f", "constant", "y"]
    x, y, keys = gathered(rows, SIZES)
    cut1, cut2 = int(0.6 * len(x)), int(0.8 * len(x))
    mx, my = x[:cut1].mean(0), y[:cut1].mean(0)
    ref = np.linalg.lstsq(x[:cut1] - mx, y[:cut1] - my, rcond=None)[0]
    coef, intercept = lagged.fit(df, features, "y")
    np.testing.assert_allclose(coef, ref, atol=1e-6)
    np.testing.assert_allclose(intercept, my - mx @ ref, atol=1e-5)
    got = {(r.location_id, r.origin): r for r in lagged.predict(df, features, "y", coef, intercept).collect()}
    assert sorted(got) == keys[cut2:]
    for i, key in list(enumerate(keys))[cut2::17]:
        np.testing.assert_allclose(got[key].forecast, x[i] @ coef + intercept, atol=1e-8)
        np.testing.assert_allclose(got[key].y, y[i])
    fitted = lagged.residual_products(df, features, "y", coef, intercept).collect()
    assert len(fitted) == FUTURE and all(r.n_windows == cut1 and r.largest_product < 1e-7 and r.mean_residual < 1e-7 for r in fitted)
    other = lagged.residual_products(df, features, "y", coef, intercept, split="test").collect()
    assert max(r.largest_product for r in other) > 1e-3


def test_no_window_no_model(spark):
    _, df = series(spark, {"C": 60})
    with pytest.raises(ValueError):
        lagged.fit(df, ["f"], "y")
    assert lagged.predict(df, ["f"], "y", np.zeros((PAST, FUTURE)), np.zeros(FUTURE)).count() == 0
