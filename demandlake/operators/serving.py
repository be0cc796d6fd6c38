"""Serving: input windows for many requests as of a target hour, imputation,
padding, post-processing and cost features (E3, E4, G9-G11, J1-J4).

As-of lookup without a range join and without sorting requests per zone:
the series is on whole hours, so "the last row at or before the target"
only depends on the zone and the target hour.  An *as-of grid* holds, for
every zone and every hour between the zone's first and last row, the index
of the last row at or before that hour.  Its size is zones x hours of the
span - independent of the number of requests - and requests reach it with
an equi-join on (zone, hour), which AQE can split when one zone-hour is
hot.  A target after the last row is clamped to the last row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandlake.functions import calendar as cal
from demandlake.operators import scaling
from demandlake.operators.features import SEQ_FEATURES
from demandlake.sources import weather as wx

ZONE = "location_id"
PAST = 72
BLOCK = 256
CEIL_SLACK = 1e-9


def series_ts(features: DataFrame) -> DataFrame:
    """Feature rows with their hour timestamp (F7) and per-zone index."""
    return features.withColumn("ts", cal.compose_ts(F.col("date"), F.col("hour")))


def zone_bounds(series: DataFrame, zone: str = ZONE) -> DataFrame:
    """One row per zone: first / last hour and row count."""
    return series.groupBy(zone).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
                                    F.count(F.lit(1)).alias("n_rows"))


def asof_grid(series: DataFrame, zone: str = ZONE, idx: str = "time_idx") -> DataFrame:
    """(zone, hour, asof_idx) for every hour of each zone's span."""
    bounds = zone_bounds(series, zone)
    # Fan-out in two steps so no single task generates every zone-hour: the
    # per-zone bounds table is tiny (one partition), its days are spread over
    # the cluster by an explicit repartition (not coalesced by AQE), and the
    # hours of each day are generated there.
    day0 = F.date_trunc("day", F.col("first_ts")).cast("timestamp_ntz")
    days = bounds.select(zone, "first_ts", "last_ts", F.explode(F.sequence(
        day0, F.col("last_ts"), F.expr("INTERVAL 1 DAY"))).alias("_day"))
    n = max(1, series.sparkSession.sparkContext.defaultParallelism)
    hours = (days.repartition(n, zone, "_day")
             .select(zone, "first_ts", "last_ts", F.explode(F.sequence(
                 F.col("_day"), F.col("_day") + F.expr("INTERVAL 23 HOURS"),
                 F.expr("INTERVAL 1 HOUR"))).alias("hour_ts"))
             .where((F.col("hour_ts") >= F.col("first_ts")) & (F.col("hour_ts") <= F.col("last_ts")))
             .select(zone, "hour_ts"))
    present = series.select(zone, F.col("ts").alias("hour_ts"), F.col(idx).alias("_idx"))
    grid = hours.join(present, [zone, "hour_ts"], "left")
    w = Window.partitionBy(zone).orderBy("hour_ts").rowsBetween(Window.unboundedPreceding, 0)
    return grid.withColumn("asof_idx", F.last("_idx", ignorenulls=True).over(w)).drop("_idx")


def resolve_requests(series: DataFrame, requests: DataFrame, target: str = "target_ts",
                     zone: str = ZONE) -> DataFrame:
    """Adds ``asof_idx``, ``n_available`` and ``status`` to each request (E3, G11):
    ``ok``, ``no_zone`` (zone absent from the series) or ``no_history``
    (no row at or before the target)."""
    bounds = zone_bounds(series, zone)
    req = requests.join(bounds, zone, "left")
    hour = F.date_trunc("hour", F.col(target)).cast("timestamp_ntz")
    req = req.withColumn("_key", F.least(hour, F.col("last_ts")))
    grid = asof_grid(series, zone).withColumnRenamed("hour_ts", "_key")
    out = req.join(grid, [zone, "_key"], "left")
    status = (F.when(F.col("n_rows").isNull(), F.lit("no_zone"))
              .when(hour < F.col("first_ts"), F.lit("no_history"))
              .otherwise(F.lit("ok")))
    return (out.withColumn("status", status)
            .withColumn("asof_idx", F.when(F.col("status") == "ok", F.col("asof_idx")))
            .withColumn("n_available", F.coalesce(F.col("asof_idx") + 1, F.lit(0)))
            .drop("_key", "first_ts", "last_ts", "n_rows"))


def zone_fill_means(series: DataFrame, feature_cols: Sequence[str], zone: str = ZONE) -> DataFrame:
    """NaN-ignoring mean of each feature over all rows of the zone."""
    return series.groupBy(zone).agg(*[F.avg(_clean(c)).alias(f"_mean_{c}") for c in feature_cols])


def _clean(c: str) -> Column:
    return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))


def window_matrices(series: DataFrame, wanted: DataFrame, params=None, feature_cols: Sequence[str] = SEQ_FEATURES,
                    past: int = PAST, zone: str = ZONE, upto_target: bool = False, block: int = BLOCK) -> DataFrame:
    """(zone, asof_idx, n_padded, x): the input matrix that ends in each
    ``wanted`` row (zone, asof_idx) of the series, repeats once.  The last
    ``past`` rows as of the row, imputed with the zone mean (G9), scaled with
    the training scaler (G7) and padded in front with the zone's mean row
    (G10).

    The series is gathered into blocks of ``block`` rows with the ``past`` - 1
    rows before them, so a row travels once and a little, and a matrix is cut
    out of its block for the wanted rows only.

    ``upto_target``: means over the rows up to the row only (no look-ahead);
    the default takes all rows of the zone, as the reference does.
    """
    p = scaling.to_dict(params) if params is not None else {}

    def scaled(c: str, x: Column) -> Column:
        return (x - F.lit(p[c][0])) / F.lit(p[c][1]) if c in p else x

    by_row = Window.partitionBy(zone).orderBy("_idx")
    scope = by_row.rowsBetween(Window.unboundedPreceding, Window.currentRow) if upto_target else Window.partitionBy(zone)
    series = series.select(zone, F.col("time_idx").alias("_idx"), *[_clean(c).alias(c) for c in feature_cols])
    rows = series.select("*", *[F.avg(c).over(scope).alias(f"_mean_{c}") for c in feature_cols])
    mean = F.array(*[F.col(f"_mean_{c}") for c in feature_cols])
    if upto_target:
        # the means move with the row: raw rows and means travel, a matrix is imputed when it is cut
        values = [F.array(*[F.col(c) for c in feature_cols]).alias("row"), mean.alias("mean")]
    else:
        values = [F.array(*[scaled(c, F.coalesce(F.col(c), F.col(f"_mean_{c}"))) for c in feature_cols]).alias("row")]
    pad = F.array(*[scaled(c, F.col(f"_mean_{c}")) for c in feature_cols])
    holders = F.sequence(F.floor(F.col("_idx") / block), F.floor((F.col("_idx") + past - 1) / block))
    blocks = (rows.select(zone, pad.alias("_pad"), F.struct("_idx", *values).alias("_entry"), F.explode(holders).alias("_block"))
              .groupBy(zone, "_block").agg(F.first("_pad").alias("_pad"), F.sort_array(F.collect_list("_entry")).alias("_held")))
    asked = wanted.select(zone, "asof_idx").distinct().withColumn("_block", F.floor(F.col("asof_idx") / block))
    first = F.greatest(F.col("asof_idx") - (past - 1), F.lit(0))
    cut = F.slice("_held", (first - F.col("_held")[0]["_idx"] + 1).cast("int"), (F.col("asof_idx") - first + 1).cast("int"))
    found = asked.join(blocks, [zone, "_block"]).select(zone, "asof_idx", "_pad", cut.alias("_cut"))
    seen = F.col("_cut")["row"]
    if upto_target:
        own = F.element_at("_cut", -1)["mean"]
        seen, front = F.transform(seen, lambda r: F.zip_with(r, own, lambda v, m: F.coalesce(v, m))), own
        if p:
            centre = F.array(*[F.struct(F.lit(p[c][0] if c in p else 0.0).alias("m"), F.lit(p[c][1] if c in p else 1.0).alias("s"))
                               for c in feature_cols])

            def centred(r: Column) -> Column:
                return F.zip_with(r, centre, lambda v, t: (v - t["m"]) / t["s"])
            seen, front = F.transform(seen, centred), centred(own)
    else:
        front = F.col("_pad")
    missing = F.lit(past) - F.size("_cut")
    return found.select(zone, "asof_idx", missing.alias("n_padded"), F.concat(F.array_repeat(front, missing), seen).alias("x"))


def serving_arrays(series: DataFrame, requests: DataFrame, params=None, feature_cols: Sequence[str] = SEQ_FEATURES,
                   past: int = PAST, request_id: str = "request_id", zone: str = ZONE, resolved: DataFrame | None = None,
                   upto_target: bool = False) -> DataFrame:
    """The input matrix of each request that has one (J3): (request id, zone,
    asof_idx, n_padded, x).  Each (zone, asof_idx) that is asked for is built
    once, and a request reaches its own by one equi-join on them.
    ``resolved``: the requests already resolved, if the caller has them.
    Matrices are large: jobs that want forecasts only take ``request_forecasts``."""
    if resolved is None:
        resolved = resolve_requests(series, requests, zone=zone)
    ok = resolved.where(F.col("status") == "ok").select(request_id, zone, "asof_idx")
    return ok.join(window_matrices(series, ok, params, feature_cols, past, zone, upto_target), [zone, "asof_idx"]).select(
        request_id, zone, "asof_idx", "n_padded", "x")


def request_forecasts(series: DataFrame, resolved: DataFrame, score: Callable[[DataFrame, list[str]], DataFrame], params=None,
                      by: Sequence[str] = (), feature_cols: Sequence[str] = SEQ_FEATURES, past: int = PAST,
                      request_id: str = "request_id", zone: str = ZONE) -> DataFrame:
    """The forecast of each resolved request that has an input matrix:
    (request id, what ``score`` adds).  ``score`` maps input matrices (keys, x)
    and the names of the keys to (keys, forecast, ...).

    A forecast depends on the matrix and the columns ``by`` of the request (the
    model it names) alone, so each (zone, asof_idx, *by) that is asked for is
    cut and scored once, and its forecast, not its matrix, travels to the
    requests: what moves with their number is a few bytes each."""
    keys = [zone, "asof_idx", *by]
    ok = resolved.where(F.col("status") == "ok").select(request_id, *keys)
    asked = ok.where(F.col(zone).isNotNull() & F.col("asof_idx").isNotNull()).select(*keys).distinct()
    arrays = asked.join(window_matrices(series, asked, params, feature_cols, past, zone), [zone, "asof_idx"])
    scored = score(arrays, keys)
    found = scored.withColumnsRenamed({c: f"_{c}" for c in keys})
    same = [F.col(c) == F.col(f"_{c}") if c not in by else F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
    return ok.join(found, reduce(and_, same)).select(request_id, *[c for c in scored.columns if c not in keys])


def serving_windows(series: DataFrame, requests: DataFrame, params=None,
                    feature_cols: Sequence[str] = SEQ_FEATURES, past: int = PAST,
                    request_id: str = "request_id", zone: str = ZONE, upto_target: bool = False) -> DataFrame:
    """Long form of ``serving_arrays``: one row per (request, position 0..71)
    with the features; ``padded`` rows stand before the zone's first row."""
    arrays = serving_arrays(series, requests, params, feature_cols, past, request_id, zone, upto_target=upto_target)
    long = arrays.select(request_id, zone, "n_padded", F.posexplode("x").alias("pos", "_row"))
    return long.select(request_id, zone, "pos", (F.col("pos") < F.col("n_padded")).alias("padded"),
                       *[F.col("_row")[i].alias(c) for i, c in enumerate(feature_cols)])


def post_process(df: DataFrame, pred: str, y_params: tuple[float, float],
                 rounding: str = "half_even", out: str | None = None) -> DataFrame:
    """Inverse-scale a forecast array, clip at 0, round (J1 half-even
    offline, J2 ceil serving).  A value within 1e-9 above an integer counts
    as that integer, so that the rounding noise of scaling there and back
    does not add a trip."""
    mean, scale = y_params
    def f(x):
        v = F.greatest(x * F.lit(scale) + F.lit(mean), F.lit(0.0))
        return F.bround(v, 0) if rounding == "half_even" else F.ceil(v - F.lit(CEIL_SLACK)).cast("double")
    return df.withColumn(out or pred, F.transform(F.col(pred), f))


def cost_features(df: DataFrame, weather: DataFrame, names: str = "all_nine",
                  date_col: str = "date", hour_col: str = "hour", carry: Sequence[str | Column] = (),
                  weather_fill: str = "zero") -> DataFrame:
    """The 16 cost-model columns for (location_id, date, hour, trips_count)
    rows (J4): calendar, calendar adjacency (D8) and the serving weather
    lookup with 0 for a missing or zero observation (E4).  Training rows use
    ``weather_fill='null'``: a plain left join, missing values left for the
    model's imputer."""
    d = F.col(date_col)
    if weather_fill == "zero":
        out = wx.weather_at(df, weather, keys=(date_col, hour_col))
    else:
        out = df.join(weather.select(date_col, hour_col, "temp", "prcp", "wspd"), [date_col, hour_col], "left")
    out = out.withColumns({
        "day_of_week": cal.day_of_week(d), "month": F.month(d), "is_weekend": cal.is_weekend(d),
        "is_holiday": cal.is_holiday(d, names), "is_month_start": cal.is_month_start(d),
        "is_month_end": cal.is_month_end(d), "day_of_year": F.dayofyear(d),
        "week_of_year": F.weekofyear(d),
        "is_pre_holiday": cal.is_holiday(F.date_add(d, 1), names),
        "is_post_holiday": cal.is_holiday(F.date_sub(d, 1), names),
    })
    return out.select(*carry, *COST_FEATURES)


# Cost-model column order.
COST_FEATURES = (
    "location_id", "trips_count", "hour", "temp", "prcp", "wspd",
    "day_of_week", "month", "is_weekend", "is_holiday",
    "is_month_start", "is_month_end", "day_of_year", "week_of_year",
    "is_pre_holiday", "is_post_holiday",
)


def forecast_hours(requests: DataFrame, forecast: str = "forecast", target: str = "target_ts") -> DataFrame:
    """One row per forecast step: hour k of a request is target + k hours,
    trips = forecast[k] (J5 input)."""
    exploded = requests.select("*", F.posexplode(F.col(forecast)).alias("step", "trips_count"))
    ts = F.timestamp_add("HOUR", F.col("step"), F.col(target))
    return exploded.withColumns({"date": F.to_date(ts), "hour": F.hour(ts)})
