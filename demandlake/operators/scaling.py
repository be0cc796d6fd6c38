"""Scaler fitting, merging, imputation and transforms.

The reference flattens the training windows (72 rows x 24 features each)
and fits a standard scaler.  A series row appears once per training window
that holds it, so the flattened statistics are *weighted* row statistics
with an integer weight per row: no 72x explosion is needed.  For the row at
0-based index i of a zone with ``ntr`` training windows (origins 72 ..
71+ntr):

    w_x(i) = max(0, min(i + 72, 71 + ntr) - max(i + 1, 72) + 1)
    w_y(j) = max(0, min(j, 71 + ntr) - max(j - 23, 72) + 1)      (targets)

``ntr = clamp(cut1 - offset, 0, n_windows)`` comes from the per-zone table.
Statistics are computed in long form (feature, x, w) in one aggregate pass.
Missing values (null / NaN) are imputed by the training mean first, as the
reference does; imputed entries count in ``n`` with zero deviation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlake.operators.sequences import FUTURE, PAST, ZONE, zone_stats


def _clean(c: Column) -> Column:
    """NaN -> null so that aggregates skip it."""
    d = c.cast("double")
    return F.nanvl(d, F.lit(None).cast("double"))


def window_weights(features: DataFrame, past: int = PAST, future: int = FUTURE,
                   fractions: Sequence[float] = (0.6, 0.8), split: str = "train",
                   zone: str = ZONE, idx: str = "time_idx") -> DataFrame:
    """Adds ``w_x`` and ``w_y``: how many windows of ``split`` hold the row
    as an input row and as a target row."""
    stats = zone_stats(features, past, future, fractions, zone)
    lo = {"train": F.lit(0), "val": F.col("cut1"), "all": F.lit(0)}[split]
    hi = {"train": F.col("cut1"), "val": F.col("cut2"), "all": F.col("n_total")}[split]
    # windows of this split inside the zone: seq_no in [lo, hi) intersect [offset, offset + n_windows)
    first = F.greatest(lo - F.col("offset"), F.lit(0))
    last = F.least(hi - F.col("offset"), F.col("n_windows"))  # exclusive
    st = stats.select(zone, "offset", "n_windows", "cut1", "cut2", "n_total").withColumns({
        "_o_lo": first + past, "_o_hi": last + past - 1})  # origins of the split, inclusive
    i = F.col(idx)
    w_x = F.greatest(F.least(i + past, F.col("_o_hi")) - F.greatest(i + 1, F.col("_o_lo")) + 1, F.lit(0))
    w_y = F.greatest(F.least(i, F.col("_o_hi")) - F.greatest(i - (future - 1), F.col("_o_lo")) + 1, F.lit(0))
    out = features.join(st.select(zone, "_o_lo", "_o_hi"), zone, "inner")
    return out.withColumns({"w_x": w_x.cast("bigint"), "w_y": w_y.cast("bigint")}).drop("_o_lo", "_o_hi")


def long_form(weighted: DataFrame, feature_cols: Sequence[str], target: str = "trips_count") -> DataFrame:
    """(feature, x, w) rows: every input feature with ``w_x``, the target
    as feature ``y`` with ``w_y``; rows of zero weight are dropped."""
    items = [F.struct(F.lit(c).alias("feature"), _clean(F.col(c)).alias("x"), F.col("w_x").alias("w"))
             for c in feature_cols]
    items.append(F.struct(F.lit("y").alias("feature"), _clean(F.col(target)).alias("x"),
                          F.col("w_y").alias("w")))
    return weighted.select(F.inline(F.array(*items))).where(F.col("w") > 0)


def fit_scaler(long: DataFrame) -> DataFrame:
    """Scaler parameters ``(feature, n, n_valid, mean, m2, scale)``.

    ``mean`` ignores missing values (0 when all are missing: G8's fill);
    ``m2`` is the weighted sum of squared deviations of the present values;
    variance = m2 / n (population); scale = sqrt(variance), 0 -> 1.

    One aggregate pass over (sum w, sum w*x, sum w*x^2).  The difference
    sum w*x^2 - (sum w*x)^2 / n is exact for integer-valued constants; a
    residue below 1e-12 of sum w*x^2 is rounding noise of a constant
    feature and is taken as 0.
    """
    valid = F.col("x").isNotNull()
    agg = long.groupBy("feature").agg(
        F.sum("w").alias("n"),
        F.coalesce(F.sum(F.when(valid, F.col("w"))), F.lit(0)).alias("n_valid"),
        F.sum(F.col("w") * F.col("x")).alias("_s1"),
        F.sum(F.col("w") * F.col("x") * F.col("x")).alias("_s2"))
    mean = F.col("_s1") / F.col("n_valid")
    raw = F.col("_s2") - F.col("_s1") * mean
    m2 = F.when(raw <= F.abs(F.col("_s2")) * F.lit(1e-12), F.lit(0.0)).otherwise(raw)
    return finish(agg.select("feature", "n", "n_valid", F.coalesce(mean, F.lit(0.0)).alias("mean"),
                             F.coalesce(m2, F.lit(0.0)).alias("m2")))


def finish(params: DataFrame) -> DataFrame:
    std = F.sqrt(F.col("m2") / F.col("n"))
    return params.withColumn("scale", F.when(std == 0, F.lit(1.0)).otherwise(std))


def merge_scaler(a: DataFrame, b: DataFrame) -> DataFrame:
    """Incremental update (G6): merge (n, mean, m2) of two fits (Chan et al.).
    Missing-value counts add up; a side without a feature contributes nothing."""
    j = a.alias("a").join(b.alias("b"), "feature", "full_outer")
    na, nb = F.coalesce(F.col("a.n"), F.lit(0)), F.coalesce(F.col("b.n"), F.lit(0))
    va, vb = F.coalesce(F.col("a.n_valid"), F.lit(0)), F.coalesce(F.col("b.n_valid"), F.lit(0))
    ma, mb = F.coalesce(F.col("a.mean"), F.lit(0.0)), F.coalesce(F.col("b.mean"), F.lit(0.0))
    m2a, m2b = F.coalesce(F.col("a.m2"), F.lit(0.0)), F.coalesce(F.col("b.m2"), F.lit(0.0))
    nv = va + vb
    delta = mb - ma
    mean = F.when(nv == 0, F.lit(0.0)).otherwise(ma + delta * vb / nv)
    m2 = m2a + m2b + F.when(nv == 0, F.lit(0.0)).otherwise(delta * delta * va * vb / nv)
    merged = j.select("feature", (na + nb).alias("n"), nv.alias("n_valid"), mean.alias("mean"), m2.alias("m2"))
    return finish(merged)


def to_dict(params) -> dict[str, tuple[float, float]]:
    """Fitted parameters as ``{feature: (mean, scale)}``.

    Like a fitted Spark ML model, scaler state lives on the driver: it has
    one row per feature of the schema, and is applied as literals inside the
    generated code, so applying it needs neither a join nor a shuffle.
    """
    if isinstance(params, dict):
        return params
    rows = params.select("feature", "mean", "scale").collect()
    return {r["feature"]: (float(r["mean"]), float(r["scale"])) for r in rows}


def impute(df: DataFrame, params, feature_cols: Sequence[str]) -> DataFrame:
    """Missing values (null / NaN) -> training mean of the feature."""
    p = to_dict(params)
    return df.withColumns({c: F.coalesce(_clean(F.col(c)), F.lit(p[c][0])) for c in feature_cols})


def transform(df: DataFrame, params, feature_cols: Sequence[str],
              inverse: bool = False, suffix: str = "") -> DataFrame:
    """(x - mean) / scale, or x * scale + mean."""
    p = to_dict(params)
    cols = {}
    for c in feature_cols:
        m, s = F.lit(p[c][0]), F.lit(p[c][1])
        x = F.col(c).cast("double")
        cols[c + suffix] = x * s + m if inverse else (x - m) / s
    return df.withColumns(cols)
