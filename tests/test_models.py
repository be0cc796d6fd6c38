import numpy as np
import pytest
from pyspark.sql import functions as F

from demandlake.operators import models


def test_fit_linear_equals_min_norm_least_squares(spark):
    rng = np.random.default_rng(5)
    n, rows_in, feats, horizon = 120, 4, 3, 2
    x = rng.normal(size=(n, rows_in, feats))
    x[:, :, 2] = 1.5                                  # a constant input -> rank deficient
    w = rng.normal(size=(rows_in * feats, horizon))
    y = x.reshape(n, -1) @ w + 0.3 + rng.normal(scale=0.01, size=(n, horizon))
    df = spark.createDataFrame([(i, x[i].tolist(), y[i].tolist()) for i in range(n)],
                               "seq_no long, x array<array<double>>, y array<double>")
    coef, icpt = models.fit_linear(df)
    flat = x.reshape(n, -1)
    xc, yc = flat - flat.mean(0), y - y.mean(0)
    ref = np.linalg.lstsq(xc, yc, rcond=None)[0]
    np.testing.assert_allclose(coef, ref, atol=1e-6)
    np.testing.assert_allclose(icpt, y.mean(0) - flat.mean(0) @ ref, atol=1e-6)
    pred = {r["seq_no"]: r["forecast"] for r in models.predict_linear(df, coef, icpt).collect()}
    np.testing.assert_allclose(pred[7], flat[7] @ coef + icpt, atol=1e-9)


def test_split_random_is_stable_and_near_60_20_20(spark):
    df = spark.range(20000).withColumnRenamed("id", "k")
    a = {r["k"]: r["split"] for r in models.split_random(df, ["k"]).collect()}
    b = {r["k"]: r["split"] for r in models.split_random(df.repartition(7), ["k"]).collect()}
    assert a == b
    share = {s: sum(1 for v in a.values() if v == s) / len(a) for s in ("train", "val", "test")}
    assert share["test"] == pytest.approx(0.2, abs=0.02) and share["val"] == pytest.approx(0.2, abs=0.02)


def test_score_sequences_calls_model_per_batch(spark):
    df = spark.createDataFrame([(i, [[float(i)] * 24] * 72) for i in range(5)], "request_id long, x array<array<double>>")
    out = {r["request_id"]: r["forecast"] for r in models.score_sequences(
        df, lambda a: np.repeat(a[:, :, 0].mean(axis=1)[:, None], 24, axis=1)).collect()}
    assert out[3] == [3.0] * 24


def test_node_table_walks_every_row_to_the_models_prediction(spark):
    """Numbers, a zone as 0/1 columns, an unknown zone and missing values;
    leaves at different depths; equal rows each keep their own prediction."""
    from demandlake.operators import trees
    rng = np.random.default_rng(11)
    rows = [(i, "abc"[i % 3], int(rng.integers(0, 24)), None if i % 17 == 0 else float(rng.normal()), 0.0) for i in range(400)]
    rows = [(i, z, h, x, {"a": 1.0, "b": 5.0, "c": 2.0}[z] * (h > 11) + (x or 0.0)) for i, z, h, x, _ in rows]
    df = spark.createDataFrame(rows, "row long, location_id string, hour int, temp double, cost double")
    model = models.fit_cost(df, ["hour", "temp"], label="cost")
    odd = spark.createDataFrame([(1000, "z", 3, None, None), (1001, "b", 3, 1e300, None), (1002, "b", 3, 1e300, None)], df.schema)
    scored = models.predict_cost(model, df.unionByName(odd), ["hour", "temp"])
    nodes = trees.node_table(model.stages[-1])
    assert nodes.where("feature is null and value is null").count() == 0
    assert nodes.where("feature < 3").count() > 0                       # the zone is split on
    got = {r["row"]: r["prediction"] for r in trees.predict(scored, nodes, ["row"]).collect()}
    want = {r["row"]: r["prediction"] for r in scored.select("row", "prediction").collect()}
    assert got.keys() == want.keys()
    assert all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)
    assert trees.predict(scored.limit(0), nodes, ["row"]).count() == 0
