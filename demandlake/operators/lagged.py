"""Linear multi-output forecasts straight from the series (H4).

The least-squares model of 24 targets on the flattened 72 x F window needs the
cross products of all window positions.  Windows of one zone overlap: position
p of the window that starts at row s is row s + p.  So with z the row vector
(features, target, 1) and s running over the windows of the split,

    S(p, l)     = sum_s z[s+p] z[s+p+l]'
    S(p + 1, l) = S(p, l) + z[e+p] z[e+p+l]' - z[a+p] z[a+p+l]'

where a is the zone's first window and e the row after its last.  What the
data must give is the 96 lag products S(0, l), summed over the series, and the
cross products of the first and of the last 95 rows of each zone.  No row is
copied 72 times and no window is gathered.

Rows are dealt into blocks of (zone, ``BLOCK`` rows) with the 95 rows that
follow as a halo, so a zone of any length is spread over tasks.  A block gives
96 small matrices, a bunch of zones one matrix over its edges; both are added
up by Spark (partial sums before the shuffle), and their size depends on the
number of features only.

Forecasts and residuals are taken per block too.  Rows are numbered from 0
within their zone (``idx``) without gaps; features and target must not be null
(impute first).  A series without any training window has no model and raises
``ValueError``; zones shorter than a window take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlake.operators.sequences import FUTURE, PAST, ZONE, zone_stats

BLOCK = 4096  # rows of a block beside its halo
BUNCH = 256   # zones whose edges one task multiplies (expected number)
SPAN = PAST + FUTURE
EDGE = SPAN - 1


def window_rows(series: DataFrame, features: Sequence[str], target: str, split: str = "train", fractions: Sequence[float] = (0.6, 0.8),
                zone: str = ZONE, idx: str = "time_idx") -> DataFrame:
    """(zone, at, first, end, z): the rows that windows of ``split`` hold;
    those windows start at rows first .. end-1 of the zone."""
    lo = {"train": F.lit(0), "val": F.col("cut1"), "test": F.col("cut2"), "all": F.lit(0)}[split]
    hi = {"train": F.col("cut1"), "val": F.col("cut2"), "test": F.col("n_total"), "all": F.col("n_total")}[split]
    inside = lambda cut: F.least(F.greatest(cut - F.col("offset"), F.lit(0)), F.col("n_windows")).cast("bigint")
    stats = zone_stats(series, PAST, FUTURE, fractions, zone)
    stats = stats.select(zone, inside(lo).alias("first"), inside(hi).alias("end")).where("first < end")
    z = F.array(*[F.col(c).cast("double") for c in features], F.col(target).cast("double"), F.lit(1.0))
    rows = series.select(zone, F.col(idx).cast("bigint").alias("at"), z.alias("z")).join(stats, zone)
    return rows.where((F.col("at") >= F.col("first")) & (F.col("at") < F.col("end") + EDGE))


def _in_blocks(rows: DataFrame, zone: str, fn: Callable, schema: str) -> DataFrame:
    """``fn(z, first start, number of windows, group)`` for every (zone, block)."""
    block = F.call_function("div", F.col("at"), F.lit(BLOCK).cast("bigint"))
    halo = F.when(F.pmod("at", F.lit(BLOCK)) < EDGE, F.array(block, block - 1)).otherwise(F.array(block))
    dealt = rows.withColumn("block", F.explode(halo)).where(
        (F.col("block") >= 0) & (F.col("block") * BLOCK < F.col("end")) & ((F.col("block") + 1) * BLOCK > F.col("first")))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at")
        begin = int(group["block"].iloc[0]) * BLOCK
        start = max(begin, int(group["first"].iloc[0]))
        n = min(begin + BLOCK, int(group["end"].iloc[0])) - start
        return fn(np.stack(group["z"].to_numpy()), start, n, group)

    return dealt.groupBy(zone, "block").applyInPandas(run, schema)


def _summed(parts: DataFrame, key: str) -> DataFrame:
    """(key, v): the vectors of each key added up, partial sums first."""
    total = parts.groupBy(key).agg(Summarizer.sum(array_to_vector("v")).alias("s"))
    return total.select(key, vector_to_array("s").alias("v"))


def _matrix(parts: DataFrame, key: str, rows: int, width: int) -> np.ndarray:
    """The summed vectors as rows of one matrix (a bounded number of them)."""
    out = np.zeros((rows, width))
    table = _summed(parts, key).toArrow()
    if table.num_rows:
        out[table[key].to_numpy()] = table["v"].combine_chunks().flatten().to_numpy().reshape(-1, width)
    return out


def _lag_products(rows: DataFrame, zone: str, width: int) -> np.ndarray:
    def products(z, start, n, group):
        lags = [(z[:n].T @ z[lag:lag + n]).ravel() for lag in range(SPAN)]
        return pd.DataFrame({"lag": np.arange(SPAN, dtype="int32"), "v": lags})

    parts = _in_blocks(rows, zone, products, "lag int, v array<double>")
    return _matrix(parts, "lag", SPAN, width * width).reshape(SPAN, width, width)


def _edge_products(rows: DataFrame, zone: str, width: int) -> np.ndarray:
    """Cross products of the rows after the last window start less those of
    the first rows, over all zones: (EDGE, width, EDGE, width)."""
    at, first, end = F.col("at"), F.col("first"), F.col("end")
    sides = F.array(F.when(at < first + EDGE, F.lit(-1)), F.when(at >= end, F.lit(1)))
    edges = rows.withColumn("side", F.explode(sides)).where(F.col("side").isNotNull())
    n_zones = rows.where(at == first).count()
    bunch = F.pmod(F.xxhash64(zone), F.lit(-(-max(1, n_zones) // BUNCH)))

    def multiply(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((EDGE * width, EDGE * width))
        for (_, side), edge in group.sort_values("at").groupby([zone, "side"], sort=False):
            v = np.concatenate(edge["z"].to_numpy())
            total += side * np.outer(v, v)
        return pd.DataFrame({"row": np.arange(len(total), dtype="int32"), "v": list(total)})

    parts = edges.groupBy(bunch.alias("bunch")).applyInPandas(multiply, "row int, v array<double>")
    return _matrix(parts, "row", EDGE * width, EDGE * width).reshape(EDGE, width, EDGE, width)


def fit(series: DataFrame, features: Sequence[str], target: str, fractions: Sequence[float] = (0.6, 0.8),
        zone: str = ZONE, idx: str = "time_idx") -> tuple[np.ndarray, np.ndarray]:
    """(coef [72 * F, 24], intercept [24]): minimum-norm least squares over the
    training windows, as an SVD-based solver gives."""
    f, width = len(features), len(features) + 2
    y, one = f, f + 1
    rows = window_rows(series, features, target, "train", fractions, zone, idx)
    lag = _lag_products(rows, zone, width)
    n = lag[0, one, one]
    if n == 0:
        raise ValueError("no training windows: no zone has as many rows as a window")
    edge = _edge_products(rows, zone, width)
    xx, xy = np.zeros((PAST, f, PAST, f)), np.zeros((PAST, f, FUTURE))
    x_sum, y_sum = np.zeros((PAST, f)), np.zeros(FUTURE)
    for p in range(SPAN):                       # lag[l] is S(p, l) here
        if p < PAST:
            x_sum[p] = lag[0, :f, one]
            for q in range(p, PAST):
                xx[p, :, q] = lag[q - p, :f, :f]
                xx[q, :, p] = xx[p, :, q].T
            xy[p] = lag[PAST - p:SPAN - p, :f, y].T
        else:
            y_sum[p - PAST] = lag[0, y, one]
        for step in range(EDGE - p):
            lag[step] += edge[p, :, p + step]
    mean_x, mean_y = x_sum.ravel() / n, y_sum / n
    xx = xx.reshape(PAST * f, PAST * f) - n * np.outer(mean_x, mean_x)
    xy = xy.reshape(PAST * f, FUTURE) - n * np.outer(mean_x, mean_y)
    coef = np.linalg.pinv(xx, rcond=1e-10, hermitian=True) @ xy
    return coef, mean_y - mean_x @ coef


def _forecast(z: np.ndarray, n: int, coef: np.ndarray, intercept: np.ndarray) -> np.ndarray:
    by_position = coef.reshape(PAST, -1, FUTURE)
    f = by_position.shape[1]
    return sum(z[p:p + n, :f] @ by_position[p] for p in range(PAST)) + intercept


def predict(series: DataFrame, features: Sequence[str], target: str, coef: np.ndarray, intercept: np.ndarray, split: str = "test",
            fractions: Sequence[float] = (0.6, 0.8), zone: str = ZONE, idx: str = "time_idx") -> DataFrame:
    """(zone, origin, y, forecast): a row per window of ``split``."""
    def run(z, start, n, group):
        y = z[:, -2]
        return pd.DataFrame({zone: group[zone].iloc[0], "origin": np.arange(start + PAST, start + PAST + n),
                             "y": [y[i + PAST:i + SPAN] for i in range(n)], "forecast": list(_forecast(z, n, coef, intercept))})

    rows = window_rows(series, features, target, split, fractions, zone, idx)
    kind = series.schema[zone].dataType.simpleString()
    return _in_blocks(rows, zone, run, f"`{zone}` {kind}, origin bigint, y array<double>, forecast array<double>")


def residual_products(series: DataFrame, features: Sequence[str], target: str, coef: np.ndarray, intercept: np.ndarray,
                      split: str = "train", fractions: Sequence[float] = (0.6, 0.8), zone: str = ZONE, idx: str = "time_idx") -> DataFrame:
    """(step, n_windows, largest_product, mean_residual): for each step the
    largest product of the residuals with an input, as a share of the norms of
    targets and inputs, and the mean residual over the root mean square target.
    Both are 0 on the split that least squares were fitted on, and only there."""
    def run(z, start, n, group):
        f = z.shape[1] - 2
        y = np.lib.stride_tricks.sliding_window_view(z[PAST:PAST + n + FUTURE - 1, -2], FUTURE)
        r = y - _forecast(z, n, coef, intercept)
        inner = np.concatenate([z[p:p + n, :f].T @ r for p in range(PAST)])
        norm = sum((z[p:p + n, :f] ** 2).sum() for p in range(PAST))
        rows = [np.r_[n, norm, (y[:, k] ** 2).sum(), r[:, k].sum(), inner[:, k]] for k in range(FUTURE)]
        return pd.DataFrame({"step": np.arange(FUTURE, dtype="int32"), "v": rows})

    rows = window_rows(series, features, target, split, fractions, zone, idx)
    v = _summed(_in_blocks(rows, zone, run, "step int, v array<double>"), "step")
    n, norm, square, total = (F.col("v")[i] for i in range(4))
    largest = F.array_max(F.transform(F.slice("v", 5, PAST * len(features)), F.abs))
    share = lambda a, b: F.when(b > 0, F.abs(a) / F.sqrt(b)).otherwise(F.lit(0.0))
    return v.select("step", n.cast("bigint").alias("n_windows"), share(largest, norm * square).alias("largest_product"),
                    share(total, n * square).alias("mean_residual"))
