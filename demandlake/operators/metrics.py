"""Forecast evaluation (I1-I12) over long-form predictions
``(model, seq_no, location_id, step, y, p)``.

All metrics are two-level aggregates: per (group, step) sums first (one
partial aggregate per task), then per group.  R2 is computed per horizon
step and averaged (multi-output ``uniform_average``), or pooled where the
reference pools.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: float64 machine epsilon, the MAPE denominator floor.
EPS = 2.220446049250313e-16


def _err(y: Column, p: Column):
    e = y - p
    return F.abs(e), e * e, F.abs(e) / F.greatest(F.abs(y), F.lit(EPS))


def _r2(ss_res: Column, ss_tot: Column) -> Column:
    """1 - res/tot; a constant target gives 1 when exact, else 0."""
    return (F.when(ss_tot == 0, F.when(ss_res == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
            .otherwise(F.lit(1.0) - ss_res / ss_tot))


def composite(mae: Column, rmse: Column, mape: Column, r2: Column) -> Column:
    """(MAE + RMSE + MAPE + (1 - R2)) / 4, lower is better."""
    return (mae + rmse + mape + (F.lit(1.0) - r2)) / 4


def evaluate(preds: DataFrame, by: Sequence[str] = ("model",), y: str = "y", p: str = "p",
             step: str = "step") -> DataFrame:
    """MAE, RMSE, MAPE (eps floor), R2 averaged over steps, Composite."""
    by = list(by)
    ae, se, ape = _err(F.col(y).cast("double"), F.col(p).cast("double"))
    per_step = preds.groupBy(*by, step).agg(
        F.count(F.lit(1)).alias("n"), F.sum(ae).alias("sae"), F.sum(se).alias("sse"),
        F.sum(ape).alias("sape"),
        (F.var_pop(F.col(y).cast("double")) * F.count(F.lit(1))).alias("sst"))
    out = per_step.groupBy(*by).agg(
        (F.sum("sae") / F.sum("n")).alias("mae"),
        F.sqrt(F.sum("sse") / F.sum("n")).alias("rmse"),
        (F.sum("sape") / F.sum("n")).alias("mape"),
        F.avg(_r2(F.col("sse"), F.col("sst"))).alias("r2"))
    return out.withColumn("composite", composite(F.col("mae"), F.col("rmse"), F.col("mape"), F.col("r2")))


def evaluate_pooled(preds: DataFrame, by: Sequence[str], y: str = "y", p: str = "p",
                    eps: bool = False) -> DataFrame:
    """Pooled metrics per group (I7): all steps together, R2 pooled, MAPE
    without the epsilon floor (a zero target gives an infinite term)."""
    yy, pp = F.col(y).cast("double"), F.col(p).cast("double")
    e = yy - pp
    if eps:
        ape = F.abs(e) / F.greatest(F.abs(yy), F.lit(EPS))
    else:
        ape = (F.when(yy != 0, F.abs(e / yy))
               .when(e == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf"))))
    out = preds.groupBy(*by).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(ape).alias("mape"),
        _r2(F.sum(e * e), F.var_pop(yy) * F.count(F.lit(1))).alias("r2"))
    return out.withColumn("composite", composite(F.col("mae"), F.col("rmse"), F.col("mape"), F.col("r2")))


def mae_by(preds: DataFrame, by: Sequence[str], y: str = "y", p: str = "p") -> DataFrame:
    """MAE per group: per zone (I8) or per zone and horizon step."""
    return preds.groupBy(*by).agg(F.avg(F.abs(F.col(y) - F.col(p))).alias("mae"))


def error_matrix_wide(long: DataFrame, rows: Sequence[str] = ("model", "location_id"), col: str = "step",
                      horizon: int = 24) -> DataFrame:
    """Zone x step MAE matrix, one column per step (I9 wide, J7-like)."""
    return long.groupBy(*rows).pivot(col, list(range(horizon))).agg(F.first("mae"))


def best(df: DataFrame, metric: str, n: int, key: str, by: Sequence[str] = ()) -> DataFrame:
    """n smallest by a metric, ties by key (D13, I10); per group when ``by``.
    Values that differ by rounding noise only (from the ninth decimal on)
    are ties."""
    level = F.rint(F.col(metric) * 1e9)
    if not by:
        return df.orderBy(level, F.col(key).asc()).limit(n)
    w = Window.partitionBy(*by).orderBy(level, F.col(key).asc())
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def model_table(metrics: DataFrame) -> DataFrame:
    """Models ranked by MAE (I6) with the improvement over the naive
    baseline on MAE and RMSE (I11).  The input has one row per model, so
    the windows below run over a handful of rows."""
    every = Window.partitionBy()
    naive = F.col("model") == "Naive"
    out = metrics.withColumns({
        "rank_mae": F.row_number().over(Window.orderBy("mae", "model")),
        "_mae0": F.max(F.when(naive, F.col("mae"))).over(every),
        "_rmse0": F.max(F.when(naive, F.col("rmse"))).over(every),
    })
    return out.withColumns({
        "mae_gain_vs_naive": (F.col("_mae0") - F.col("mae")) / F.col("_mae0"),
        "rmse_gain_vs_naive": (F.col("_rmse0") - F.col("rmse")) / F.col("_rmse0"),
    }).drop("_mae0", "_rmse0")
