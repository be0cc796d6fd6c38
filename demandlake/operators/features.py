"""Per-zone ordered features over the hourly series.

All per-zone window columns use one window specification, so Catalyst plans
a single exchange on the zone and a single sort for lags, rolling
statistics and the time index together.  The window runs on the
*aggregated* series: a zone holds at most one row per hour (8,760 a year),
so its partition size is bounded by the time span, not by the trip volume.
Offsets count rows, not hours, as in the reference: in a sparse series
``lag_24h`` is "24 observed rows ago".
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandlake.functions import calendar as cal

ZONE = "location_id"
ORDER = ("date", "hour")

# Model input order of the 24 sequence features.
SEQ_FEATURES = (
    "trips_count", "hour_sin", "hour_cos", "dow_sin", "dow_cos",
    "is_holiday", "month", "is_weekend", "is_month_start", "is_month_end",
    "day_of_year", "week_of_year", "is_pre_holiday", "is_post_holiday",
    "lag_1h", "lag_24h", "lag_168h", "roll_168h_mean", "roll_168h_median", "roll_168h_std",
    "time_idx", "temp", "prcp", "wspd",
)

# Column order of the 28-column feature table.
FEATURE_TABLE = (
    "date", "hour", "location_id", "trips_count",
    "day_of_week", "month", "is_weekend", "is_holiday", "is_month_start", "is_month_end",
    "day_of_year", "week_of_year", "is_pre_holiday", "is_post_holiday",
    "lag_1h", "lag_24h", "lag_168h", "hour_sin", "hour_cos", "dow_sin", "dow_cos",
    "roll_168h_mean", "roll_168h_median", "roll_168h_std", "time_idx",
    "temp", "prcp", "wspd",
)


def zone_window(zone: str = ZONE, order: Sequence[str] = ORDER):
    return Window.partitionBy(zone).orderBy(*order)


def with_lags(df: DataFrame, lags: Sequence[int] = (1, 24, 168), value: str = "trips_count",
              fill: str = "zero", zone: str = ZONE, order: Sequence[str] = ORDER) -> DataFrame:
    """``lag_{k}h`` = value k rows earlier in the zone.

    ``fill='zero'``: missing -> 0 (batch job).  ``fill='bfill'``: missing ->
    the next available lag value of the same zone (D2; the original filled
    from the next row of the whole table, crossing zones - not reproduced).
    A zone shorter than k+1 rows has nothing to fill from and gets 0.
    """
    w = zone_window(zone, order)
    raw = {k: F.lag(F.col(value), k).over(w).cast("double") for k in lags}
    if fill != "bfill":
        return df.withColumns({f"lag_{k}h": F.coalesce(raw[k], F.lit(0.0)) for k in lags})
    # The first k rows of a zone have no lag; the next available one is that
    # of row k, the zone's first value - if the zone has more than k rows.
    first = F.first(F.col(value), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = F.count(F.lit(1)).over(Window.partitionBy(zone))
    return df.withColumns({
        f"lag_{k}h": F.coalesce(raw[k], F.when(rows > k, first.cast("double")), F.lit(0.0)) for k in lags})


def with_time_lags(df: DataFrame, hours: Sequence[int] = (1, 24, 168), value: str = "trips_count",
                   zone: str = ZONE, order: Sequence[str] = ORDER) -> DataFrame:
    """``lag_time_{k}h`` = value exactly k hours earlier in the zone, null
    when that hour has no row (D14, time-true lag)."""
    hour = F.unix_date(F.col(order[0])).cast("bigint") * 24 + F.col(order[1])
    w = Window.partitionBy(zone).orderBy(hour)
    return df.withColumns({f"lag_time_{k}h": F.first(F.col(value)).over(w.rangeBetween(-k, -k)).cast("double") for k in hours})


def with_rolling(df: DataFrame, n: int = 168, value: str = "trips_count",
                 zone: str = ZONE, order: Sequence[str] = ORDER) -> DataFrame:
    """Rolling mean, exact median and sample std over the last ``n`` rows
    including the current one, minimum one row; std of one row -> 0 (D3-D5)."""
    frame = zone_window(zone, order).rowsBetween(-(n - 1), Window.currentRow)
    v = F.col(value).cast("double")
    return df.withColumns({
        f"roll_{n}h_mean": F.avg(v).over(frame),
        f"roll_{n}h_median": F.percentile(v, 0.5).over(frame),
        f"roll_{n}h_std": F.coalesce(F.stddev_samp(v).over(frame), F.lit(0.0)),
    })


def with_time_idx(df: DataFrame, zone: str = ZONE, order: Sequence[str] = ORDER) -> DataFrame:
    """0-based running number per zone."""
    return df.withColumn("time_idx", (F.row_number().over(zone_window(zone, order)) - 1).cast("bigint"))


def with_row_adjacency(df: DataFrame, date_col: str = "date", hour_col: str = "hour",
                       zone: str = ZONE, names: str = "all_nine") -> DataFrame:
    """Batch adjacency (D7): holiday flag of the next / previous row's date
    in the table sorted by (date, hour, zone); end rows are 0.

    Inside a date the neighbour row has the same date, so the flag differs
    from ``is_holiday`` only on the last (pre) or first (post) row of a
    date.  Those rows and the neighbouring present dates are found on the
    distinct-date table (one row per day); no global sort
    of the fact table is needed.
    """
    key = F.struct(F.col(hour_col), F.col(zone))
    days = df.groupBy(date_col).agg(F.max(key).alias("_last"), F.min(key).alias("_first"))
    by_date = Window.orderBy(date_col)
    days = days.select(
        date_col, "_last", "_first",
        F.coalesce(cal.is_holiday(F.lead(date_col).over(by_date), names), F.lit(0)).alias("_next_hol"),
        F.coalesce(cal.is_holiday(F.lag(date_col).over(by_date), names), F.lit(0)).alias("_prev_hol"))
    own = cal.is_holiday(F.col(date_col), names)
    out = df.join(days, date_col, "left")
    return (out.withColumns({
        "is_pre_holiday": F.when(key == F.col("_last"), F.col("_next_hol")).otherwise(own).cast("int"),
        "is_post_holiday": F.when(key == F.col("_first"), F.col("_prev_hol")).otherwise(own).cast("int"),
    }).drop("_last", "_first", "_next_hol", "_prev_hol"))


def with_weather(df: DataFrame, weather: DataFrame, keys: Sequence[str] = ("date", "hour"),
                 cols: Sequence[str] = ("temp", "prcp", "wspd")) -> DataFrame:
    """Left join of hourly weather; unmatched hours get null weather.

    The weather side has at most one row per hour of its time span; the
    runtime broadcasts it when its measured size allows.
    """
    w = weather.select(*keys, *cols)
    return df.join(w, list(keys), "left")


def build_features(hourly: DataFrame, weather: DataFrame | None = None,
                   adjacency: str = "calendar", names: str = "all_nine",
                   lag_fill: str = "zero", rolling: int = 168) -> DataFrame:
    """The 28-column feature table (engineer_features + merge_weather)."""
    out = cal.with_calendar(hourly, names=names)
    if adjacency == "row":
        out = with_row_adjacency(out, names=names)
    else:
        out = cal.with_calendar_adjacency(out, names=names)
    out = with_lags(out, fill=lag_fill)
    out = with_rolling(out, n=rolling)
    out = with_time_idx(out)
    if weather is not None:
        out = with_weather(out, weather)
    else:
        out = out.withColumns({c: F.lit(None).cast("double") for c in ("temp", "prcp", "wspd")})
    return out.select(*FEATURE_TABLE)


def sorted_series(df: DataFrame, zone: str = ZONE, storage: bool = False) -> DataFrame:
    """Order by (zone, datetime) (D9).  For storage the data is clustered by
    zone and sorted within partitions instead of one total order."""
    if storage:
        return df.repartition(zone).sortWithinPartitions(zone, "date", "hour")
    return df.orderBy(zone, "date", "hour")
