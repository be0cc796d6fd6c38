"""Sliding training windows, zone index and the global ordered split
(D10, G1-G3, G12).

A window is identified by its zone and its *origin*: the 0-based row index
(``time_idx``) of the first target row.  Inputs are rows origin-72 ..
origin-1, targets rows origin .. origin+23; a zone with n rows has
``max(0, n - 95)`` windows.  Nothing is materialised 72 times: targets are
24 ``lead`` values of the same per-zone window, and the inputs are only
gathered as arrays when a model needs them (``input_arrays``).

The reference numbers windows globally (zone by zone, in time order) and
cuts train/val/test at ``int(.6 n)`` and ``int(.8 n)``.  Instead of a global
``row_number`` (one task), each zone's window count is computed on the
per-zone table (one row per zone) and turned into offsets there; the
sequence number is ``offset + origin - 72``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ZONE = "location_id"
PAST, FUTURE = 72, 24


def zone_index(series: DataFrame, zone: str = ZONE) -> DataFrame:
    """Dense 0-based zone index in ascending zone order (D10): the order of
    first appearance once the series is sorted by zone.  Computed on the
    distinct-zone table (one row per zone)."""
    zones = series.select(zone).distinct()
    return zones.withColumn("zone_idx", (F.dense_rank().over(Window.orderBy(zone)) - 1).cast("bigint"))


def zone_stats(series: DataFrame, past: int = PAST, future: int = FUTURE,
               fractions: Sequence[float] = (0.6, 0.8), zone: str = ZONE) -> DataFrame:
    """One row per zone: rows, windows, zone index, global offset, and the
    global split cuts (G3).  Window functions here run over the per-zone
    table only."""
    z = series.groupBy(zone).agg(F.count(F.lit(1)).alias("n_rows"))
    z = z.withColumn("n_windows", F.greatest(F.col("n_rows") - (past + future - 1), F.lit(0)))
    order = Window.orderBy(zone)
    every = Window.partitionBy()
    z = z.select(
        zone, "n_rows", "n_windows",
        (F.row_number().over(order) - 1).cast("bigint").alias("zone_idx"),
        F.coalesce(F.sum("n_windows").over(order.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).cast("bigint").alias("offset"),
        F.sum("n_windows").over(every).cast("bigint").alias("n_total"))
    lo, hi = fractions
    return z.withColumns({
        "cut1": F.floor(F.col("n_total") * F.lit(lo)).cast("bigint"),
        "cut2": F.floor(F.col("n_total") * F.lit(hi)).cast("bigint"),
    })


def split_of(seq_no, cut1, cut2):
    return (F.when(seq_no < cut1, F.lit("train"))
            .when(seq_no < cut2, F.lit("val")).otherwise(F.lit("test")))


def windows(features: DataFrame, past: int = PAST, future: int = FUTURE,
            value: str = "trips_count", fractions: Sequence[float] = (0.6, 0.8),
            zone: str = ZONE, order: Sequence[str] = ("date", "hour"),
            baselines: bool = True) -> DataFrame:
    """One row per window (G1, G3): ``seq_no, location_id, zone_idx, origin,
    split, y`` (24 targets) and, with ``baselines``, the three baseline
    inputs: last value, value 72 rows back, mean of the 72 inputs (H1-H3)."""
    w = Window.partitionBy(zone).orderBy(*order)
    v = F.col(value).cast("double")
    cols = {
        "_idx": (F.row_number().over(w) - 1).cast("bigint"),
        "y": F.array(*[F.lead(v, k).over(w) for k in range(future)]),
    }
    if baselines:
        cols.update({
            "last_value": F.lag(v, 1).over(w),
            "value_back": F.lag(v, past).over(w),
            "window_mean": F.avg(v).over(w.rowsBetween(-past, -1)),
        })
    rows = features.withColumns(cols)
    stats = zone_stats(features, past, future, fractions, zone)
    out = rows.join(stats.select(zone, "n_rows", "zone_idx", "offset", "n_total", "cut1", "cut2"), zone, "inner")
    out = out.where((F.col("_idx") >= past) & (F.col("_idx") <= F.col("n_rows") - future))
    seq_no = (F.col("offset") + F.col("_idx") - past).cast("bigint")
    keep = ["seq_no", zone, "zone_idx", "origin", "origin_date", "origin_hour", "split", "n_total",
            "cut1", "cut2", "y"]
    if baselines:
        keep += ["last_value", "value_back", "window_mean"]
    return (out.withColumns({
        "seq_no": seq_no,
        "origin": F.col("_idx"),
        "origin_date": F.col(order[0]),
        "origin_hour": F.col(order[1]) if len(order) > 1 else F.lit(None),
        "split": split_of(seq_no, F.col("cut1"), F.col("cut2")),
    }).select(*keep))


def targets_long(win: DataFrame) -> DataFrame:
    """(seq_no, step, y): one row per window and horizon step."""
    return win.select("seq_no", "location_id", "zone_idx", "split", "n_total", "cut2",
                      F.posexplode("y").alias("step", "y"))


def day_block(test: DataFrame, seq_col: str = "seq_no", start_col: str = "cut2",
              block: int = 24) -> DataFrame:
    """Day-block truncation of the test set (G12): sample number
    s = seq_no - cut2; keep the first floor(m / 24) * 24 samples, where m is
    the number of test samples; ``hour_of_day = s mod 24``."""
    s = F.col(seq_col) - F.col(start_col)
    m = F.col("n_total") - F.col(start_col)  # test-set size, known from the zone table
    return (test.withColumn("sample_no", s)
            .where(F.col("sample_no") < F.floor(m / block) * block)
            .withColumn("hour_of_day", F.pmod(F.col("sample_no"), F.lit(block))))


def input_arrays(features: DataFrame, feature_cols: Sequence[str], past: int = PAST,
                 zone: str = ZONE, order: Sequence[str] = ("date", "hour")) -> DataFrame:
    """X for model input: the 72 preceding rows as ``array<array<double>>``
    per row (G1).  Materialise only where a model consumes it."""
    w = Window.partitionBy(zone).orderBy(*order)
    vec = F.array(*[F.col(c).cast("double") for c in feature_cols])
    return features.withColumns({
        "_idx": (F.row_number().over(w) - 1).cast("bigint"),
        "x": F.collect_list(vec).over(w.rowsBetween(-past, -1)),
    }).withColumnRenamed("_idx", "origin")
