"""Forecasters and the cost model on Spark ML.

* H4: multi-output least squares on windows that are gathered already, from
  any source.  For windows of a series ``lagged`` fits and forecasts without
  gathering them.
* H5/H6: cost preprocessing (one-hot zone with unknown -> zeros, mean
  imputer, standard scaler) and a gradient-boosted tree regressor in one
  ``Pipeline``; saved with ``PipelineModel.write``.
* H7: scoring with a model the user supplies (any ``predict_fn`` over a
  numpy batch) through ``mapInPandas``: Arrow batches, model shipped once
  per task, not per row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandlake.sources.registry import Shipped


def split_random(df: DataFrame, keys: Sequence[str], seed: int = 42,
                 test: float = 0.2, val_of_rest: float = 0.25) -> DataFrame:
    """Stable random 60/20/20 split (G4): the first 32 bits of the MD5 of the
    key columns and the seed give a number in [0, 1); re-running gives the
    same split on any cluster and in any engine, unlike sampling that
    depends on partitioning."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    u = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(float(2 ** 32))
    rest_cut = test
    val_cut = test + (1 - test) * val_of_rest
    return df.withColumn("split", F.when(u < rest_cut, F.lit("test"))
                         .when(u < val_cut, F.lit("val")).otherwise(F.lit("train")))


# --- H4 ------------------------------------------------------------------

def fit_linear(train: DataFrame, x_col: str = "x", y_col: str = "y") -> tuple[np.ndarray, np.ndarray]:
    """Multi-output least squares with intercept (H4), exact, on the JVM.

    Each row becomes one vector [x, y] (x flattened: 1,728 values, y: 24
    targets).  ``Summarizer`` gives means and variances and
    ``Correlation`` the correlation matrix, both as tree aggregates over the
    vector column without leaving the JVM; together they give the centred
    cross-product matrix, whose size depends on the number of features
    only (about 1,750 squared), never on the rows.  The centred normal
    equations are solved with a pseudo-inverse: the minimum-norm
    least-squares solution, as an SVD-based solver gives when some inputs
    are constant.  Returns (coef [n_x, n_y], intercept [n_y]).
    """
    from pyspark.ml.stat import Correlation, Summarizer
    data = train.select(array_to_vector(F.concat(F.flatten(F.col(x_col)), F.col(y_col))).alias("v"))
    ny = train.agg(F.max(F.size(y_col))).first()[0]
    st = data.select(Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("s")).first()["s"]
    corr = np.nan_to_num(Correlation.corr(data, "v").first()[0].toArray())
    n = float(st["count"])
    mean = st["mean"].toArray()
    std = np.sqrt(st["variance"].toArray())       # sample variance
    centred = corr * np.outer(std, std) * (n - 1)  # sum of centred cross products
    nx = len(mean) - ny
    xx, xy = centred[:nx, :nx], centred[:nx, nx:]
    coef = np.linalg.pinv(xx, rcond=1e-10, hermitian=True) @ xy
    return coef, mean[nx:] - mean[:nx] @ coef


def predict_linear(df: DataFrame, coef: np.ndarray, intercept: np.ndarray,
                   id_col: str = "seq_no", x_col: str = "x") -> DataFrame:
    """Forecast arrays with the fitted coefficients (shipped once per task)."""
    def run(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = np.stack(pdf["_xf"].to_numpy()).astype("float64")
            y = x @ coef + intercept
            yield pd.DataFrame({id_col: pdf[id_col], "forecast": list(y)})
    schema = T.StructType([df.schema[id_col], T.StructField("forecast", T.ArrayType(T.DoubleType()))])
    # flattened in the JVM: one 1,728-value array per row reaches Arrow
    return df.select(id_col, F.flatten(x_col).alias("_xf")).mapInPandas(run, schema)


# --- H5/H6 ---------------------------------------------------------------

def cost_pipeline(numeric: Sequence[str], zone: str = "location_id", label: str = "avg_cost_per_mile",
                  seed: int = 42, max_iter: int = 20) -> Pipeline:
    """One-hot zone (unknown -> all zeros), mean imputation, scaling, GBT."""
    idx = StringIndexer(inputCol=zone, outputCol="_zone_idx", handleInvalid="keep")
    ohe = OneHotEncoder(inputCols=["_zone_idx"], outputCols=["_zone_vec"], dropLast=True,
                        handleInvalid="keep")
    imp = Imputer(inputCols=list(numeric), outputCols=[f"_imp_{c}" for c in numeric], strategy="mean")
    vec = VectorAssembler(inputCols=[f"_imp_{c}" for c in numeric], outputCol="_num")
    sc = StandardScaler(inputCol="_num", outputCol="_num_s", withMean=True, withStd=True)
    feats = VectorAssembler(inputCols=["_zone_vec", "_num_s"], outputCol="features")
    gbt = GBTRegressor(featuresCol="features", labelCol=label, maxIter=max_iter, maxDepth=6, seed=seed)
    return Pipeline(stages=[idx, ohe, imp, vec, sc, feats, gbt])


def fit_cost(df: DataFrame, numeric: Sequence[str], label: str = "avg_cost_per_mile") -> PipelineModel:
    cast = df.withColumns({c: F.col(c).cast("double") for c in numeric}).withColumn(
        "location_id", F.col("location_id").cast("string"))
    return cost_pipeline(numeric, label=label).fit(cast)


def predict_cost(model: PipelineModel, df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    cast = df.withColumns({c: F.col(c).cast("double") for c in numeric}).withColumn(
        "location_id", F.col("location_id").cast("string"))
    return model.transform(cast)


def regression_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """MAE, RMSE, R2 of a single-output model."""
    e = F.col(y) - F.col(p)
    out = df.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
                 F.sum(e * e).alias("_res"), (F.var_pop(y) * F.count(F.lit(1))).alias("_tot"),
                 F.count(F.lit(1)).alias("n"))
    return out.select("n", "mae", "rmse", F.when(F.col("_tot") == 0,
                                           F.when(F.col("_res") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
                      .otherwise(F.lit(1.0) - F.col("_res") / F.col("_tot")).alias("r2"))


# --- H7 ------------------------------------------------------------------

def score_sequences(df: DataFrame, predict_fn: Callable[[np.ndarray], np.ndarray],
                    id_col: str | Sequence[str] = "request_id", x_col: str = "x", horizon: int = 24,
                    n_features: int = 24, dtype: str = "float64") -> DataFrame:
    """Score input windows with a user model (H7): (ids, forecast).

    ``predict_fn`` maps an array (n, 72, 24) of ``dtype`` to (n, horizon).  It is
    pickled once with the task closure and called once per Arrow batch.
    """
    ids = [id_col] if isinstance(id_col, str) else list(id_col)

    def run(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = np.stack(pdf["_xf"].to_numpy()).astype(dtype).reshape(len(pdf), -1, n_features)
            y = np.asarray(predict_fn(x), dtype="float64").reshape(len(pdf), horizon)
            yield pd.DataFrame({**{c: pdf[c] for c in ids}, "forecast": list(y)})
    schema = T.StructType([*[df.schema[c] for c in ids], T.StructField("forecast", T.ArrayType(T.DoubleType()))])
    # flattened in the JVM: one array per row reaches Arrow, reshaped per batch
    return df.select(*ids, F.flatten(x_col).alias("_xf")).mapInPandas(run, schema)


def score_by_name(df: DataFrame, shipped: Shipped, id_col: str | Sequence[str] = "request_id", x_col: str = "x", model_col: str = "model",
                  horizon: int = 24, n_features: int = 24, dtype: str = "float64") -> DataFrame:
    """Score input windows with the model each row names (H7), in one pass:
    (ids, forecast, model_status).  The rows of an Arrow batch go to each named
    model together; a name that is null or not in the registry gives no
    forecast and the status ``unknown_model``."""
    ids = [id_col] if isinstance(id_col, str) else list(id_col)

    def run(batches):
        for pdf in batches:
            forecast, status = [None] * len(pdf), ["unknown_model"] * len(pdf)
            for name, at in pdf.groupby(model_col).indices.items():
                predict = shipped.model(name)
                if predict is not None:
                    x = np.stack([pdf["_xf"].iloc[i] for i in at]).astype(dtype).reshape(len(at), -1, n_features)
                    y = np.asarray(predict(x), dtype="float64").reshape(len(at), horizon)
                    for i, row in zip(at, y):
                        forecast[i], status[i] = row, "ok"
            yield pd.DataFrame({**{c: pdf[c] for c in ids}, "forecast": forecast, "model_status": status})
    schema = T.StructType([*[df.schema[c] for c in ids], T.StructField("forecast", T.ArrayType(T.DoubleType())),
                           T.StructField("model_status", T.StringType())])
    return df.select(*dict.fromkeys([*ids, model_col]), F.flatten(x_col).alias("_xf")).mapInPandas(run, schema)


# --- a cost model as a table -------------------------------------------------

def fit_cost_lines(df: DataFrame, keys: Sequence[str] = ("location_id", "hour"), x: str = "trips_count",
                   y: str = "avg_cost_per_mile") -> DataFrame:
    """Least squares of cost on trips per key, as a table (keys, slope,
    intercept): one partial aggregate.  A key whose trips do not vary gets the
    mean and slope 0."""
    flat = F.coalesce(F.var_pop(x), F.lit(0.0)) == 0
    fit = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(
        F.when(flat, F.lit(0.0)).otherwise(F.regr_slope(F.col(y), F.col(x).cast("double"))).alias("slope"),
        F.when(flat, F.avg(y)).otherwise(F.regr_intercept(F.col(y), F.col(x).cast("double"))).alias("intercept"))
    return fit


def price_by_lines(forecasts: DataFrame, lines: DataFrame, keys: Sequence[str] = ("location_id", "hour"),
                   id_col: str = "request_id") -> DataFrame:
    """Every forecast hour priced with a model table (J5, F13): (id, demand,
    trip_costs) in step order, null where the table has no row.  Only requests
    with a positive cost are priced; a request is 24 rows."""
    from demandlake.operators import serving
    hours = serving.forecast_hours(forecasts.where(F.col("cost") > 0)).join(lines, list(keys), "left")
    cost = F.bround(F.greatest(F.col("intercept") + F.col("slope") * F.col("trips_count"), F.lit(0.0)), 2)
    steps = F.sort_array(F.collect_list(F.struct("step", "trips_count", cost.alias("c"))))
    return hours.groupBy(id_col).agg(steps.alias("_s")).select(id_col, F.col("_s.trips_count").alias("demand"), F.col("_s.c").alias("trip_costs"))


def price_forecast(forecasts: DataFrame, cost_model: PipelineModel, weather: DataFrame,
                   numeric: Sequence[str], id_col: str = "request_id") -> DataFrame:
    """Price every forecast hour (J5): hour k at target + k h with the
    forecast trips as demand; prices in step order per request.  Requests
    that agree in zone, target and forecast have the same prices: each such
    forecast is priced once (24 rows, so collecting it is bounded) and
    requests reach it by one equi-join.  Only requests with a positive
    cost are priced; cost = round(max(0, prediction), 2) (F13)."""
    from demandlake.operators import serving
    paid = forecasts.where(F.col("cost") > 0)
    keys = ["location_id", "target_ts", "forecast"]
    hours = serving.forecast_hours(paid.select(*keys).distinct())
    rows = serving.cost_features(hours, weather, carry=(*[F.col(c).alias(f"_{c}") for c in keys], "step"))
    priced = predict_cost(cost_model, rows, numeric)
    cost = F.bround(F.greatest(F.col("prediction"), F.lit(0.0)), 2)
    prices = priced.groupBy(*[f"_{c}" for c in keys]).agg(F.collect_list(F.struct("step", cost.alias("c"))).alias("_s"))
    own = paid.join(prices, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]))
    return (own.groupBy(id_col).agg(F.sort_array(F.flatten(F.collect_list("_s"))).alias("_s"))
            .select(id_col, F.col("_s.c").alias("trip_costs")))
