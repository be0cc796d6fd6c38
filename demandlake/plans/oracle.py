"""DuckDB twins of the registered queries (views: region nation customer
supplier part orders lineitem events documents embeddings pages benchmark
labels conversations)."""

from __future__ import annotations

from demandlake.plans import sqlfrag as q

ORACLE: dict[str, str] = {}

# --- shared CTE bodies -----------------------------------------------------

TRIPS = """
    SELECT DISTINCT ts AS pickup_ts, event_type AS location_id
    FROM events
    WHERE ts >= TIMESTAMP '2024-01-01 00:00:00' AND ts < TIMESTAMP '2024-02-01 00:00:00'
      AND ts IS NOT NULL AND event_type IS NOT NULL
"""

HOURLY = f"""
    SELECT CAST(pickup_ts AS DATE) AS date, hour(pickup_ts) AS hour, location_id,
           count(*) AS trips_count
    FROM ({TRIPS}) t
    GROUP BY ALL
"""

WEATHER = """
    SELECT CAST(date_trunc('hour', ts) AS DATE) AS date, hour(date_trunc('hour', ts)) AS hour,
           avg(value) AS temp, min(value) AS prcp, max(value) AS wspd
    FROM events
    WHERE (dayofyear(date_trunc('hour', ts)) * 24 + hour(date_trunc('hour', ts))) % 11 <> 0
    GROUP BY ALL
"""


def features_sql(adjacency: str = "calendar", names: str = "all_nine", fill: str = "zero") -> str:
    w = "PARTITION BY location_id ORDER BY date, hour"
    frame = f"({w} ROWS BETWEEN 167 PRECEDING AND CURRENT ROW)"
    if adjacency == "calendar":
        pre = q.is_holiday("date + INTERVAL 1 DAY", names)
        post = q.is_holiday("date - INTERVAL 1 DAY", names)
    else:
        # neighbour row of the whole table in (date, hour, location_id) order
        pre = q.is_holiday("lead(date) OVER (ORDER BY date, hour, location_id)", names)
        post = q.is_holiday("lag(date) OVER (ORDER BY date, hour, location_id)", names)
    lags = []
    for k in (1, 24, 168):
        if fill == "zero":
            lags.append(f"coalesce(CAST(lag(trips_count, {k}) OVER ({w}) AS DOUBLE), 0.0) AS lag_{k}h")
        else:
            lags.append(f"CAST(lag(trips_count, {k}) OVER ({w}) AS DOUBLE) AS _lag{k}")
    body = f"""
    SELECT date, hour, location_id, trips_count,
           isodow(date) - 1 AS day_of_week, month(date) AS month,
           CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend,
           {q.is_holiday('date', names)} AS is_holiday,
           CASE WHEN day(date) = 1 THEN 1 ELSE 0 END AS is_month_start,
           CASE WHEN date = last_day(date) THEN 1 ELSE 0 END AS is_month_end,
           dayofyear(date) AS day_of_year, weekofyear(date) AS week_of_year,
           {pre} AS is_pre_holiday,
           {post} AS is_post_holiday,
           {', '.join(lags)},
           {q.cyc('hour', 24, 'sin')} AS hour_sin, {q.cyc('hour', 24, 'cos')} AS hour_cos,
           {q.cyc('isodow(date) - 1', 7, 'sin')} AS dow_sin, {q.cyc('isodow(date) - 1', 7, 'cos')} AS dow_cos,
           avg(trips_count) OVER {frame} AS roll_168h_mean,
           median(CAST(trips_count AS DOUBLE)) OVER {frame} AS roll_168h_median,
           coalesce(stddev_samp(trips_count) OVER {frame}, 0.0) AS roll_168h_std,
           row_number() OVER ({w}) - 1 AS time_idx,
           wx.temp, wx.prcp, wx.wspd
    FROM ({HOURLY}) h LEFT JOIN ({WEATHER}) wx USING (date, hour)
    """
    if fill == "bfill":
        fills = ", ".join(
            f"coalesce(_lag{k}, first(_lag{k} IGNORE NULLS) OVER (PARTITION BY location_id ORDER BY date, hour"
            f" ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0.0) AS lag_{k}h" for k in (1, 24, 168))
        body = f"SELECT *, {fills} FROM ({body}) b"
    return body


FEATURE_KINDS = {
    "date": "day", "hour": "i", "location_id": "s", "trips_count": "i",
    "day_of_week": "i", "month": "i", "is_weekend": "i", "is_holiday": "i", "is_month_start": "i",
    "is_month_end": "i", "day_of_year": "i", "week_of_year": "i", "is_pre_holiday": "i",
    "is_post_holiday": "i", "lag_1h": "d", "lag_24h": "d", "lag_168h": "d", "hour_sin": "d",
    "hour_cos": "d", "dow_sin": "d", "dow_cos": "d", "roll_168h_mean": "d", "roll_168h_median": "d",
    "roll_168h_std": "d", "time_idx": "i", "temp": "d", "prcp": "d", "wspd": "d",
}

ORACLE["hourly_demand"] = q.select(HOURLY, {"date": "day", "hour": "i", "location_id": "s",
                                            "trips_count": "i"})
ORACLE["hourly_features"] = q.select(features_sql(), FEATURE_KINDS)
ORACLE["hourly_features_row_adjacency"] = q.select(
    features_sql("row", "batch_exact", "bfill"),
    {k: FEATURE_KINDS[k] for k in ("date", "hour", "location_id", "is_holiday", "is_pre_holiday",
                                   "is_post_holiday", "lag_1h", "lag_24h", "lag_168h")})


ORACLE["time_lags"] = q.select(f"""
    WITH h AS (SELECT *, CAST(date AS TIMESTAMP) + to_hours(CAST(hour AS BIGINT)) AS at FROM ({HOURLY}) x)
    SELECT h.date, h.hour, h.location_id, h.trips_count, a.trips_count AS lag_time_1h, b.trips_count AS lag_time_24h,
           c.trips_count AS lag_time_168h
    FROM h LEFT JOIN h a ON a.location_id = h.location_id AND a.at = h.at - INTERVAL 1 HOUR
    LEFT JOIN h b ON b.location_id = h.location_id AND b.at = h.at - INTERVAL 24 HOUR
    LEFT JOIN h c ON c.location_id = h.location_id AND c.at = h.at - INTERVAL 168 HOUR
""", {"date": "day", "hour": "i", "location_id": "s", "trips_count": "i", "lag_time_1h": "d", "lag_time_24h": "d",
      "lag_time_168h": "d"})


# --- sources, cleaning, unification ----------------------------------------

def _feed(table, ts, zone, start="1995-01-01", end="2024-02-01", distinct=True):
    return f"""
    SELECT {'DISTINCT' if distinct else ''} {ts} AS pickup_ts, CAST({zone} AS VARCHAR) AS location_id
    FROM {table}
    WHERE {ts} >= TIMESTAMP '{start} 00:00:00' AND {ts} < TIMESTAMP '{end} 00:00:00'
      AND {ts} IS NOT NULL AND {zone} IS NOT NULL"""


FEEDS = (("events", "ts", "event_type"), ("orders", "o_orderdate", "o_orderpriority"),
         ("lineitem", "l_shipdate", "l_returnflag"))
TRIP_KINDS = {"location_id": "s", "date": "day", "hour": "i"}


def _unified(distinct_each: bool) -> str:
    body = " UNION ALL ".join(_feed(*f, distinct=distinct_each) for f in FEEDS)
    if not distinct_each:
        body = f"SELECT DISTINCT * FROM ({body}) u"
    return f"SELECT location_id, CAST(pickup_ts AS DATE) AS date, hour(pickup_ts) AS hour FROM ({body}) t"


ORACLE["unified_trips"] = q.select(_unified(True), TRIP_KINDS)
ORACLE["unified_trips_global_dedup"] = q.select(_unified(False), TRIP_KINDS)

ORACLE["feeds_with_missing_columns"] = ORACLE["unified_trips"]
ORACLE["text_timestamp_feed"] = q.select("""
    SELECT location_id, CAST(pickup_ts AS DATE) AS date, hour(pickup_ts) AS hour FROM (
      SELECT DISTINCT ts AS pickup_ts, event_type AS location_id FROM events
      WHERE event_id % 7 <> 0 AND ts >= TIMESTAMP '2024-01-01 00:00:00' AND ts < TIMESTAMP '2024-02-01 00:00:00') t
""", TRIP_KINDS)
ORACLE["directory_listing"] = q.select("SELECT event_type, count(*) AS n_rows FROM events GROUP BY 1",
                                       {"event_type": "s", "n_rows": "i"})

EXCLUDED = ("103, 104, 198, 211, 216, 225, 226, 228, 229, 230, 231, 232, 233, 234, "
            "236, 237, 238, 239, 244, 246, 247, 249, 255, 256, 261, 262, 263")


def _hourly_cost(distance: str, where: str) -> str:
    return f"""
    SELECT CAST(pickup_ts AS DATE) AS date, hour(pickup_ts) AS hour, location_id,
           avg(cost_per_mile) AS avg_cost_per_mile, count(*) AS trips_count
    FROM (SELECT DISTINCT l_shipdate AS pickup_ts, l_suppkey AS location_id, l_extendedprice / {distance} AS cost_per_mile
          FROM lineitem
          WHERE {distance} > 0 AND l_extendedprice > 0 AND l_shipdate IS NOT NULL AND l_suppkey IS NOT NULL
            AND {where}) t
    GROUP BY ALL
"""


HOURLY_COST = _hourly_cost("l_quantity", "TRUE")
COST_KINDS = {"date": "day", "hour": "i", "location_id": "i", "avg_cost_per_mile": "d", "trips_count": "i"}
ORACLE["hourly_cost"] = q.select(HOURLY_COST, COST_KINDS)
ORACLE["cost_filters"] = q.select(_hourly_cost(
    "l_partkey", f"l_suppkey BETWEEN 1 AND 265 AND l_suppkey NOT IN ({EXCLUDED}) AND l_extendedprice / l_partkey < 100.0"),
    COST_KINDS)

WIDE = " UNION ALL ".join(
    f"SELECT {ts} AS pickup_ts, {z} AS location_id, {amt} AS amount FROM {t}"
    for t, ts, z, amt in (("events", "ts", "event_type", "value"),
                          ("orders", "o_orderdate", "o_orderpriority", "o_totalprice"),
                          ("lineitem", "l_shipdate", "l_returnflag", "l_extendedprice")))
ORACLE["wide_feed_duplicates"] = q.select(f"""
    SELECT sum(c) AS n_rows, count(*) AS distinct_rows, sum(c) - count(*) AS duplicates
    FROM (SELECT pickup_ts, location_id, amount, count(*) AS c FROM ({WIDE}) w GROUP BY ALL) g
""", {"n_rows": "i", "distinct_rows": "i", "duplicates": "i"})

ORACLE["orders_out_of_range"] = q.select("""
    SELECT count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1996-01-01 00:00:00'
                             OR o_orderdate > TIMESTAMP '2000-12-31 00:00:00') AS n_out_of_range,
           count(*) AS n_rows, min(o_orderdate) AS min_ts, max(o_orderdate) AS max_ts
    FROM orders
""", {"n_out_of_range": "i", "n_rows": "i", "min_ts": "ts", "max_ts": "ts"})

ORACLE["trips_row_count"] = q.select(f"""
    SELECT count(*) AS n_rows, count(*) > 0 AS non_empty FROM ({TRIPS}) t
""", {"n_rows": "i", "non_empty": "i"})

ORACLE["feed_classification"] = q.select("""
    SELECT 'events' AS feed, count(*) AS n_rows FROM events
    UNION ALL SELECT 'orders', count(*) FROM orders
    UNION ALL SELECT 'lineitem', count(*) FROM lineitem
""", {"feed": "s", "n_rows": "i"})
ORACLE["hourly_csv_stage"] = q.select(HOURLY, {"date": "day", "hour": "i", "location_id": "s",
                                               "trips_count": "i"})

# --- profiles ----------------------------------------------------------------

_EV_COLS = (("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"),
            ("event_type", "string"), ("value", "double"), ("props", "string"))
ORACLE["events_column_profile"] = q.select(" UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS column_name, '{t}' AS dtype, count(*) FILTER (WHERE {c} IS NULL) "
    f"AS null_count, count(*) AS n_rows, {len(_EV_COLS)} AS n_columns, "
    f"round(count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*), 2) AS null_pct FROM events"
    for i, (c, t) in enumerate(_EV_COLS)),
    {"position": "i", "column_name": "s", "dtype": "s", "null_count": "i", "n_rows": "i",
     "n_columns": "i", "null_pct": "d"})

ORACLE["weather_null_ratio"] = q.select(f"""
    SELECT avg(CASE WHEN temp IS NULL THEN 1.0 ELSE 0.0 END) AS null_ratio FROM ({features_sql()}) f
""", {"null_ratio": "d"})

ORACLE["user_value_counts"] = q.select("""
    SELECT user_id, count(*) AS n FROM events WHERE user_id IS NOT NULL
    GROUP BY user_id ORDER BY n DESC, user_id ASC LIMIT 10
""", {"user_id": "i", "n": "i"})

ORACLE["events_nunique"] = q.select("""
    SELECT count(DISTINCT user_id) AS nunique_user_id, count(DISTINCT event_type) AS nunique_event_type
    FROM events
""", {"nunique_user_id": "i", "nunique_event_type": "i"})

ORACLE["busiest_hours"] = q.select("""
    SELECT hour(ts) AS hour, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, hour ASC LIMIT 10
""", {"hour": "i", "n": "i"})

ORACLE["rides_by_hour"] = q.select(f"""
    SELECT hour, sum(trips_count) AS total_rides FROM ({HOURLY}) h GROUP BY hour
""", {"hour": "i", "total_rides": "i"})

ORACLE["rides_by_weekday"] = q.select(f"""
    SELECT isodow(date) - 1 AS day_of_week, sum(trips_count) AS total_rides FROM ({HOURLY}) h GROUP BY 1
""", {"day_of_week": "i", "total_rides": "i"})

ORACLE["holiday_vs_regular"] = q.select(f"""
    SELECT is_holiday, avg(daily_total) AS mean_daily_total, count(*) AS n_days FROM (
      SELECT date, is_holiday, sum(trips_count) AS daily_total FROM ({features_sql()}) f GROUP BY ALL
    ) d GROUP BY is_holiday
""", {"is_holiday": "i", "mean_daily_total": "d", "n_days": "i"})

ORACLE["top_cost_zones"] = q.select(f"""
    SELECT location_id, sum(trips_count) AS total FROM ({HOURLY_COST}) h
    GROUP BY location_id ORDER BY total DESC, location_id ASC LIMIT 10
""", {"location_id": "i", "total": "i"})

_SEQ = ("trips_count", "hour_sin", "hour_cos", "dow_sin", "dow_cos", "is_holiday", "month", "is_weekend",
        "is_month_start", "is_month_end", "day_of_year", "week_of_year", "is_pre_holiday", "is_post_holiday",
        "lag_1h", "lag_24h", "lag_168h", "roll_168h_mean", "roll_168h_median", "roll_168h_std",
        "time_idx", "temp", "prcp", "wspd")
ORACLE["zone_feature_means"] = q.select(
    f"SELECT location_id, {', '.join(f'avg(CAST({c} AS DOUBLE)) AS {c}' for c in _SEQ)} "
    f"FROM ({features_sql()}) f GROUP BY location_id",
    {"location_id": "s", **{c: "d" for c in _SEQ}})

# --- calendar, weather, stations ------------------------------------------------

ORACLE["holiday_calendar"] = q.select(f"""
    SELECT date, name, CASE WHEN name IN ('New Year''s Day', 'Washington''s Birthday', 'Memorial Day',
                'Independence Day', 'Labor Day', 'Christmas Day') THEN 1 ELSE 0 END AS in_batch_set
    FROM (
      SELECT CAST(d AS DATE) AS date, {q.holiday_name('CAST(d AS DATE)')} AS name
      FROM (SELECT min(year(o_orderdate)) AS y0, max(year(o_orderdate)) AS y1 FROM orders) b,
           generate_series(make_date(y0, 1, 1), make_date(y1, 12, 31), INTERVAL 1 DAY) AS g(d)
    ) x WHERE name IS NOT NULL
""", {"date": "day", "name": "s", "in_batch_set": "i"})

ORACLE["weather_hourly"] = q.select(WEATHER, {"date": "day", "hour": "i", "temp": "d", "prcp": "d",
                                              "wspd": "d"})

ORACLE["nearest_station"] = q.select("""
    SELECT station_id, distance_km FROM (
      SELECT s_suppkey AS station_id,
             2 * 6371.0088 * asin(sqrt(pow(sin((radians(40.0 + s_nationkey / 10.0) - radians(40.7128)) / 2), 2)
               + cos(radians(40.7128)) * cos(radians(40.0 + s_nationkey / 10.0))
                 * pow(sin((radians(-75.0 + s_acctbal / 5000.0) - radians(-74.0060)) / 2), 2))) AS distance_km
      FROM supplier
    ) s ORDER BY distance_km, station_id LIMIT 1
""", {"station_id": "i", "distance_km": "d"})

ORACLE["feature_stage_roundtrip"] = ORACLE["hourly_features"]
ORACLE["feature_sample_head"] = q.select(
    f"SELECT * FROM ({features_sql()}) f ORDER BY location_id, date, hour LIMIT 15", FEATURE_KINDS)

ORACLE["sorted_series"] = q.select(f"""
    SELECT location_id, count(*) AS n_rows, 0 AS n_swapped FROM ({HOURLY}) h GROUP BY location_id
""", {"location_id": "s", "n_rows": "i", "n_swapped": "i"})

ORACLE["zone_index"] = q.select(f"""
    SELECT location_id, dense_rank() OVER (ORDER BY location_id) - 1 AS zone_idx
    FROM (SELECT DISTINCT location_id FROM ({HOURLY}) h) z
""", {"location_id": "s", "zone_idx": "i"})

# --- windows, scaler, baselines, metrics -----------------------------------------

ZONES = f"""
    SELECT *, floor(CAST(n_total AS DOUBLE) * 0.6) AS cut1, floor(CAST(n_total AS DOUBLE) * 0.8) AS cut2
    FROM (
      SELECT location_id, n_rows, n_windows,
             row_number() OVER (ORDER BY location_id) - 1 AS zone_idx,
             coalesce(sum(n_windows) OVER (ORDER BY location_id ROWS BETWEEN UNBOUNDED PRECEDING
                                           AND 1 PRECEDING), 0) AS off,
             sum(n_windows) OVER () AS n_total
      FROM (SELECT location_id, count(*) AS n_rows, greatest(count(*) - 95, 0) AS n_windows
            FROM ({HOURLY}) h GROUP BY location_id) z
    ) z2
"""
SERIES = f"""
    SELECT h.*, row_number() OVER w - 1 AS idx,
           CAST(lag(trips_count, 1) OVER w AS DOUBLE) AS last_value,
           CAST(lag(trips_count, 72) OVER w AS DOUBLE) AS value_back,
           avg(trips_count) OVER (PARTITION BY location_id ORDER BY date, hour
                                  ROWS BETWEEN 72 PRECEDING AND 1 PRECEDING) AS window_mean
    FROM ({HOURLY}) h
    WINDOW w AS (PARTITION BY location_id ORDER BY date, hour)
"""
WINDOWS = f"""
    SELECT CAST(off + idx - 72 AS BIGINT) AS seq_no, s.location_id, zone_idx, idx AS origin,
           date AS origin_date, hour AS origin_hour,
           CASE WHEN off + idx - 72 < cut1 THEN 'train' WHEN off + idx - 72 < cut2 THEN 'val'
                ELSE 'test' END AS split,
           n_total, cut1, cut2, last_value, value_back, window_mean
    FROM ({SERIES}) s JOIN ({ZONES}) z ON s.location_id = z.location_id
    WHERE idx >= 72 AND idx <= n_rows - 24
"""
TARGETS = f"""
    SELECT w.*, t.step, CAST(s.trips_count AS DOUBLE) AS y
    FROM ({WINDOWS}) w CROSS JOIN range(24) AS t(step)
    JOIN ({SERIES}) s ON s.location_id = w.location_id AND s.idx = w.origin + t.step
"""
# least squares leave no product with any input: zeros, on the training windows
ORACLE["linear_residual_products"] = q.select(f"""
    SELECT t.step, max(z.cut1) AS n_windows, 0.0 AS largest_product, 0.0 AS mean_residual
    FROM ({ZONES}) z CROSS JOIN range(24) AS t(step) GROUP BY t.step
""", {"step": "i", "n_windows": "i", "largest_product": "d4", "mean_residual": "d4"})
ORACLE["sequence_windows"] = q.select(WINDOWS, {
    "seq_no": "i", "location_id": "s", "zone_idx": "i", "origin": "i", "origin_date": "day",
    "origin_hour": "i", "split": "s"})
ORACLE["window_targets"] = q.select(TARGETS, {"seq_no": "i", "step": "i", "y": "d"})


def _scaler_sql(where: str = "TRUE", feats=None, cut: str = "cut1") -> str:
    feats = feats or _SEQ
    weighted = f"""
        SELECT f.*,
          greatest(least(time_idx + 72, o_hi) - greatest(time_idx + 1, o_lo) + 1, 0) AS w_x,
          greatest(least(time_idx, o_hi) - greatest(time_idx - 23, o_lo) + 1, 0) AS w_y
        FROM ({features_sql()}) f JOIN (
          SELECT location_id, greatest(0 - off, 0) + 72 AS o_lo,
                 least({cut} - off, n_windows) + 72 - 1 AS o_hi FROM ({ZONES}) z0) z
        ON f.location_id = z.location_id
        WHERE {where}
    """
    long = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CASE WHEN isnan(CAST({c} AS DOUBLE)) THEN NULL ELSE CAST({c} AS DOUBLE) END AS x, "
        f"w_x AS w FROM wt WHERE w_x > 0" for c in feats)
    long += " UNION ALL SELECT 'y' AS feature, CAST(trips_count AS DOUBLE) AS x, w_y AS w FROM wt WHERE w_y > 0"
    return f"""
    WITH wt AS ({weighted}), lf AS ({long}),
    m AS (SELECT feature, sum(w) AS n, coalesce(sum(w) FILTER (WHERE x IS NOT NULL), 0) AS n_valid,
                 coalesce(sum(w * x) / sum(w) FILTER (WHERE x IS NOT NULL), 0.0) AS mean
          FROM lf GROUP BY feature),
    d AS (SELECT lf.feature, coalesce(sum(w * pow(x - m.mean, 2)), 0.0) AS m2
          FROM lf JOIN m ON lf.feature = m.feature GROUP BY lf.feature)
    SELECT m.feature, n, n_valid, mean,
           CASE WHEN sqrt(m2 / n) = 0 THEN 1.0 ELSE sqrt(m2 / n) END AS scale
    FROM m JOIN d ON m.feature = d.feature
    """


SCALER_KINDS = {"feature": "s", "n": "i", "n_valid": "i", "mean": "d", "scale": "d"}
ORACLE["scaler_params"] = q.select(_scaler_sql(), SCALER_KINDS)
ORACLE["scaler_params_merged"] = ORACLE["scaler_params"]
ORACLE["scaler_params_six"] = q.select(_scaler_sql(feats=("trips_count", "hour_sin", "hour_cos", "dow_sin",
                                                          "dow_cos", "is_holiday")), SCALER_KINDS)
ORACLE["refit_scaler"] = q.select(_scaler_sql(cut="cut2"), SCALER_KINDS)
ORACLE["scaled_features"] = q.select(f"""
    WITH p AS ({_scaler_sql()})
    SELECT date, hour, location_id,
      {', '.join(f"(coalesce(CASE WHEN isnan(CAST({c} AS DOUBLE)) THEN NULL ELSE CAST({c} AS DOUBLE) END, "
                 f"(SELECT mean FROM p WHERE feature = '{c}')) - (SELECT mean FROM p WHERE feature = '{c}')) "
                 f"/ (SELECT scale FROM p WHERE feature = '{c}') AS {c}" for c in _SEQ)}
    FROM ({features_sql()}) f
""", {"date": "day", "hour": "i", "location_id": "s", **{c: "d" for c in _SEQ}})

PREDS = f"""
    SELECT seq_no, location_id, zone_idx, origin_hour, step, y, n_total, cut2, m.model,
           CASE m.model WHEN 'Naive' THEN last_value WHEN 'Seasonal' THEN value_back
                ELSE window_mean END AS p
    FROM ({TARGETS}) t CROSS JOIN (VALUES ('Naive'), ('Seasonal'), ('MovingAvg')) AS m(model)
    WHERE split = 'test'
"""
ORACLE["baseline_forecasts"] = q.select(PREDS, {"seq_no": "i", "location_id": "s", "step": "i",
                                                "model": "s", "y": "d", "p": "d"})
EPS = "2.220446049250313e-16"
METRICS = f"""
    WITH st AS (
      SELECT model, step, count(*) AS n, sum(abs(y - p)) AS sae, sum((y - p) * (y - p)) AS sse,
             sum(abs(y - p) / greatest(abs(y), {EPS})) AS sape, var_pop(y) * count(*) AS sst
      FROM ({PREDS}) pr GROUP BY model, step),
    mm AS (
      SELECT model, sum(sae) / sum(n) AS mae, sqrt(sum(sse) / sum(n)) AS rmse, sum(sape) / sum(n) AS mape,
             avg(CASE WHEN sst = 0 THEN (CASE WHEN sse = 0 THEN 1.0 ELSE 0.0 END) ELSE 1.0 - sse / sst END) AS r2
      FROM st GROUP BY model)
    SELECT model, mae, rmse, mape, r2, (mae + rmse + mape + (1 - r2)) / 4 AS composite,
           row_number() OVER (ORDER BY mae, model) AS rank_mae,
           (max(mae) FILTER (WHERE model = 'Naive') OVER () - mae) / max(mae) FILTER (WHERE model = 'Naive') OVER ()
             AS mae_gain_vs_naive,
           (max(rmse) FILTER (WHERE model = 'Naive') OVER () - rmse) / max(rmse) FILTER (WHERE model = 'Naive') OVER ()
             AS rmse_gain_vs_naive
    FROM mm
"""
ORACLE["baseline_metrics"] = q.select(METRICS, {
    "model": "s", "mae": "d", "rmse": "d", "mape": "d", "r2": "d", "composite": "d", "rank_mae": "i",
    "mae_gain_vs_naive": "d", "rmse_gain_vs_naive": "d"})

BY_HOUR = f"""
    SELECT model, hour_of_day, mae, rmse, mape, r2, (mae + rmse + mape + (1 - r2)) / 4 AS composite FROM (
      SELECT model, (seq_no - cut2) % 24 AS hour_of_day, avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse,
             avg(CASE WHEN y <> 0 THEN abs((y - p) / y) WHEN y = p THEN 'nan'::DOUBLE ELSE 'inf'::DOUBLE END) AS mape,
             CASE WHEN var_pop(y) * count(*) = 0 THEN (CASE WHEN sum((y - p) * (y - p)) = 0 THEN 1.0 ELSE 0.0 END)
                  ELSE 1.0 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) END AS r2
      FROM ({PREDS}) pr
      WHERE seq_no - cut2 < floor((n_total - cut2) / 24) * 24
      GROUP BY ALL) x
"""
ORACLE["errors_by_hour"] = q.select(BY_HOUR, {"model": "s", "hour_of_day": "i", "mae": "d", "rmse": "d",
                                              "mape": "d", "r2": "d", "composite": "d"})
ORACLE["errors_by_origin_hour"] = q.select(f"""
    SELECT model, origin_hour, mae, rmse, mape, r2, (mae + rmse + mape + (1 - r2)) / 4 AS composite FROM (
      SELECT model, origin_hour, avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse,
             avg(CASE WHEN y <> 0 THEN abs((y - p) / y) WHEN y = p THEN 'nan'::DOUBLE ELSE 'inf'::DOUBLE END) AS mape,
             CASE WHEN var_pop(y) * count(*) = 0 THEN (CASE WHEN sum((y - p) * (y - p)) = 0 THEN 1.0 ELSE 0.0 END)
                  ELSE 1.0 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) END AS r2
      FROM ({PREDS}) pr GROUP BY ALL) x
""", {"model": "s", "origin_hour": "i", "mae": "d", "rmse": "d", "mape": "d", "r2": "d", "composite": "d"})
BY_ZONE = f"SELECT model, location_id, avg(abs(y - p)) AS mae FROM ({PREDS}) pr GROUP BY ALL"
ORACLE["errors_by_zone"] = q.select(BY_ZONE, {"model": "s", "location_id": "s", "mae": "d"})
ORACLE["error_matrix"] = q.select(
    f"SELECT model, location_id, step, avg(abs(y - p)) AS mae FROM ({PREDS}) pr GROUP BY ALL",
    {"model": "s", "location_id": "s", "step": "i", "mae": "d"})
ORACLE["best_hours"] = q.select(f"""
    SELECT * FROM (SELECT model, row_number() OVER (PARTITION BY model ORDER BY round_even(composite * 1e9, 0), hour_of_day) AS rank,
                          hour_of_day, composite FROM ({BY_HOUR}) b) r WHERE rank <= 10
""", {"model": "s", "rank": "i", "hour_of_day": "i", "composite": "d"})
ORACLE["best_zones"] = q.select(f"""
    SELECT * FROM (SELECT model, row_number() OVER (PARTITION BY model ORDER BY round_even(mae * 1e9, 0), location_id) AS rank,
                          location_id, mae FROM ({BY_ZONE}) b) r WHERE rank <= 10
""", {"model": "s", "rank": "i", "location_id": "s", "mae": "d"})


# --- serving -------------------------------------------------------------------

SERIES_TS = f"SELECT *, CAST(date AS TIMESTAMP) + to_hours(CAST(hour AS BIGINT)) AS ts FROM ({features_sql()}) f0"
REQUESTS = """
    SELECT e.event_id AS request_id, e.user_id, e.ts AS target_ts, h.location_id
    FROM events e LEFT JOIN (
      SELECT user_id, first(event_type ORDER BY ts, event_id) AS location_id FROM events GROUP BY user_id
    ) h ON e.user_id = h.user_id
    WHERE e.event_type = 'purchase'
"""


def _resolved(requests_sql: str) -> str:
    return f"""
    SELECT r.request_id, r.location_id, r.target_ts,
           CASE WHEN b.n_rows IS NULL THEN 'no_zone'
                WHEN date_trunc('hour', r.target_ts) < b.first_ts THEN 'no_history' ELSE 'ok' END AS status,
           CASE WHEN b.n_rows IS NOT NULL AND date_trunc('hour', r.target_ts) >= b.first_ts
                THEN (SELECT max(s.time_idx) FROM ({SERIES_TS}) s
                      WHERE s.location_id = r.location_id AND s.ts <= r.target_ts) END AS asof_idx
    FROM ({requests_sql}) r LEFT JOIN (
      SELECT location_id, min(ts) AS first_ts, count(*) AS n_rows FROM ({SERIES_TS}) s0 GROUP BY location_id
    ) b ON r.location_id = b.location_id
"""


RESOLVED = _resolved(REQUESTS)
ORACLE["serving_status"] = q.select(
    f"SELECT *, coalesce(asof_idx + 1, 0) AS n_available FROM ({RESOLVED}) x",
    {"request_id": "i", "location_id": "s", "target_ts": "ts", "status": "s", "asof_idx": "i",
     "n_available": "i"})


def _nan(c: str) -> str:
    return f"CASE WHEN isnan(CAST({c} AS DOUBLE)) THEN NULL ELSE CAST({c} AS DOUBLE) END"


ORACLE["serving_windows"] = q.select(f"""
    WITH p AS ({_scaler_sql()}),
    s AS ({SERIES_TS}),
    m AS (SELECT location_id, {', '.join(f'avg({_nan(c)}) AS m_{c}' for c in _SEQ)} FROM s GROUP BY location_id),
    pos AS (SELECT request_id, location_id, r.pos, asof_idx - 71 + r.pos AS src
            FROM ({RESOLVED}) x CROSS JOIN range(72) AS r(pos) WHERE status = 'ok')
    SELECT pos.request_id, pos.location_id, pos.pos, pos.src < 0 AS padded,
      {', '.join(f"(coalesce({_nan('s.' + c)}, m.m_{c}) - (SELECT mean FROM p WHERE feature = '{c}')) "
                 f"/ (SELECT scale FROM p WHERE feature = '{c}') AS {c}" for c in _SEQ)}
    FROM pos LEFT JOIN s ON s.location_id = pos.location_id AND s.time_idx = pos.src
    JOIN m ON m.location_id = pos.location_id
""", {"request_id": "i", "location_id": "s", "pos": "i", "padded": "i", **{c: "d" for c in _SEQ}})

ORACLE["serving_windows_upto_target"] = q.select(f"""
    WITH p AS ({_scaler_sql()}),
    s AS ({SERIES_TS}),
    m AS (SELECT location_id, time_idx,
                 {', '.join(f'avg({_nan(c)}) OVER (PARTITION BY location_id ORDER BY time_idx) AS m_{c}' for c in _SEQ)} FROM s),
    pos AS (SELECT request_id, location_id, r.pos, asof_idx, asof_idx - 71 + r.pos AS src
            FROM ({RESOLVED}) x CROSS JOIN range(72) AS r(pos) WHERE status = 'ok')
    SELECT pos.request_id, pos.location_id, pos.pos, pos.src < 0 AS padded,
      {', '.join(f"(coalesce({_nan('s.' + c)}, m.m_{c}) - (SELECT mean FROM p WHERE feature = '{c}')) "
                 f"/ (SELECT scale FROM p WHERE feature = '{c}') AS {c}" for c in _SEQ)}
    FROM pos LEFT JOIN s ON s.location_id = pos.location_id AND s.time_idx = pos.src
    JOIN m ON m.location_id = pos.location_id AND m.time_idx = pos.asof_idx
""", {"request_id": "i", "location_id": "s", "pos": "i", "padded": "i", **{c: "d" for c in _SEQ}})

ORACLE["cost_features"] = q.select(f"""
    SELECT location_id, trips_count, hour,
      CASE WHEN isnan(w.temp) THEN 'nan'::DOUBLE WHEN coalesce(w.temp, 0) = 0 THEN 0.0 ELSE w.temp END AS temp,
      CASE WHEN isnan(w.prcp) THEN 'nan'::DOUBLE WHEN coalesce(w.prcp, 0) = 0 THEN 0.0 ELSE w.prcp END AS prcp,
      CASE WHEN isnan(w.wspd) THEN 'nan'::DOUBLE WHEN coalesce(w.wspd, 0) = 0 THEN 0.0 ELSE w.wspd END AS wspd,
      isodow(date) - 1 AS day_of_week, month(date) AS month,
      CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend,
      {q.is_holiday('date')} AS is_holiday,
      CASE WHEN day(date) = 1 THEN 1 ELSE 0 END AS is_month_start,
      CASE WHEN date = last_day(date) THEN 1 ELSE 0 END AS is_month_end,
      dayofyear(date) AS day_of_year, weekofyear(date) AS week_of_year,
      {q.is_holiday('date + INTERVAL 1 DAY')} AS is_pre_holiday,
      {q.is_holiday('date - INTERVAL 1 DAY')} AS is_post_holiday
    FROM ({HOURLY}) h LEFT JOIN ({WEATHER}) w USING (date, hour)
""", {"location_id": "s", "trips_count": "i", "hour": "i", "temp": "d", "prcp": "d", "wspd": "d",
      "day_of_week": "i", "month": "i", "is_weekend": "i", "is_holiday": "i", "is_month_start": "i",
      "is_month_end": "i", "day_of_year": "i", "week_of_year": "i", "is_pre_holiday": "i",
      "is_post_holiday": "i"})

ORACLE["post_processed_forecasts"] = q.select(f"""
    WITH p AS ({_scaler_sql()}),
    y AS (SELECT mean AS my, scale AS sy FROM p WHERE feature = 'y')
    SELECT seq_no, t.step,
           round_even(greatest(((window_mean - my) / sy) * sy + my, 0.0), 0) AS p_round,
           CAST(ceil(greatest(((window_mean - my) / sy) * sy + my, 0.0) - 1e-9) AS DOUBLE) + 0.0 AS p_ceil
    FROM ({WINDOWS}) w CROSS JOIN y CROSS JOIN range(24) AS t(step)
    WHERE split = 'test'
""", {"seq_no": "i", "step": "i", "p_round": "d", "p_ceil": "d"})

# --- accounts --------------------------------------------------------------------

CENTS = "CAST(floor(o_totalprice / 100.0 * 100.0 + 0.5) AS BIGINT)"
OPS = f"""
    SELECT o_custkey AS user_id, o_orderkey AS op_id, o_orderdate AS ts,
           CASE WHEN o_orderstatus = 'F' THEN 'deposit' ELSE 'withdraw' END AS kind,
           {CENTS} AS amount_cents,
           row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn
    FROM orders
"""
def _replay_sql(ops_sql: str) -> str:
    return f"""
    WITH RECURSIVE ops AS ({ops_sql}),
    r AS (
      SELECT user_id, rn, op_id, kind, amount_cents,
             CASE WHEN kind = 'deposit' THEN amount_cents > 0 ELSE amount_cents >= 0 AND amount_cents <= 0 END
               AS accepted,
             CASE WHEN kind = 'deposit' AND amount_cents > 0 THEN amount_cents ELSE 0 END AS balance_cents
      FROM ops WHERE rn = 1
      UNION ALL
      SELECT o.user_id, o.rn, o.op_id, o.kind, o.amount_cents,
             CASE WHEN o.kind = 'deposit' THEN o.amount_cents > 0
                  ELSE o.amount_cents >= 0 AND o.amount_cents <= r.balance_cents END,
             CASE WHEN o.kind = 'deposit' AND o.amount_cents > 0 THEN r.balance_cents + o.amount_cents
                  WHEN o.kind = 'withdraw' AND o.amount_cents >= 0 AND o.amount_cents <= r.balance_cents
                    THEN r.balance_cents - o.amount_cents
                  ELSE r.balance_cents END
      FROM r JOIN ops o ON o.user_id = r.user_id AND o.rn = r.rn + 1
    )
    SELECT user_id, op_id, kind, amount_cents, accepted, balance_cents FROM r
    """


ORACLE["ledger_replay"] = q.select(_replay_sql(OPS), {
    "user_id": "i", "op_id": "i", "kind": "s", "amount_cents": "i", "accepted": "i", "balance_cents": "i"})

ACCEPTED = f"""
    SELECT r.user_id, r.op_id, o.o_orderdate AS ts, r.kind, r.amount_cents, r.balance_cents,
           CASE WHEN r.kind = 'deposit' THEN r.amount_cents ELSE -r.amount_cents END AS signed_cents
    FROM ({_replay_sql(OPS)}) r JOIN orders o ON o.o_orderkey = r.op_id WHERE r.accepted
"""
ORACLE["ledger_balances"] = q.select(ACCEPTED, {"user_id": "i", "op_id": "i", "signed_cents": "i", "balance_cents": "i"})
ORACLE["owner_lookup"] = q.select(f"SELECT user_id, op_id, kind, amount_cents FROM ({OPS}) o", {
    "user_id": "i", "op_id": "i", "kind": "s", "amount_cents": "i"})

ORACLE["ledger_history"] = q.select(f"""
    SELECT * FROM (
      SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, op_id DESC) AS position,
             op_id, ts, signed_cents
      FROM ({ACCEPTED}) a) h WHERE position <= 5
""", {"user_id": "i", "position": "i", "op_id": "i", "ts": "ts", "signed_cents": "i"})

TIER = ("CASE WHEN c_acctbal >= 8000.0 THEN 'diamond' WHEN c_acctbal >= 5000.0 THEN 'gold' "
        "WHEN c_acctbal >= 2000.0 THEN 'silver' ELSE 'bronze' END")
USERS = f"""
    SELECT c_custkey AS user_id, c_name AS username, {TIER} AS tier,
           CASE WHEN {TIER} <> 'bronze' THEN DATE '2024-01-01' + CAST(floor(c_acctbal / 100) AS INTEGER) END
             AS tier_end,
           CAST(floor(c_acctbal * 100.0 + 0.5) AS BIGINT) AS balance_cents
    FROM customer
"""
PRICE = ("CASE tier WHEN 'bronze' THEN 20.0 WHEN 'silver' THEN 15.0 WHEN 'gold' THEN 10.0 "
         "ELSE 5.0 END")
ORACLE["request_prices"] = q.select(f"""
    SELECT user_id, tier, {PRICE} AS price,
           CASE tier WHEN 'bronze' THEN 0.0 WHEN 'silver' THEN 100.0 WHEN 'gold' THEN 200.0
                     WHEN 'diamond' THEN 500.0 END AS tier_price
    FROM ({USERS}) u
""", {"user_id": "i", "tier": "s", "price": "d", "tier_price": "d"})

ORACLE["daily_quota"] = q.select(f"""
    SELECT request_id, user_id, day, tier, paid,
           paid OR tier = 'diamond'
             OR rn <= CASE coalesce(tier, 'bronze') WHEN 'bronze' THEN 10 WHEN 'silver' THEN 100 ELSE 1000 END
             AS passes
    FROM (
      SELECT e.event_id AS request_id, e.user_id, CAST(e.ts AS DATE) AS day, u.tier,
             e.event_type = 'purchase' AS paid,
             row_number() OVER (PARTITION BY e.user_id, CAST(e.ts AS DATE) ORDER BY e.ts, e.event_id) AS rn
      FROM events e LEFT JOIN ({USERS}) u ON e.user_id = u.user_id
    ) x
""", {"request_id": "i", "user_id": "i", "day": "day", "tier": "s", "paid": "i", "passes": "i"})

ORACLE["affordability"] = q.select(f"""
    SELECT e.event_id AS request_id, e.user_id, u.tier,
           CASE coalesce(u.tier, 'bronze') WHEN 'bronze' THEN 20.0 WHEN 'silver' THEN 15.0
                WHEN 'gold' THEN 10.0 ELSE 5.0 END AS price,
           CASE coalesce(u.tier, 'bronze') WHEN 'bronze' THEN 20.0 WHEN 'silver' THEN 15.0
                WHEN 'gold' THEN 10.0 ELSE 5.0 END * 100 <= coalesce(u.balance_cents, 0) AS affordable
    FROM events e LEFT JOIN ({USERS}) u ON e.user_id = u.user_id
    WHERE e.event_type = 'purchase'
""", {"request_id": "i", "user_id": "i", "tier": "s", "price": "d", "affordable": "i"})

ORACLE["tier_expiry"] = q.select(f"""
    SELECT user_id,
           CASE WHEN tier_end IS NOT NULL AND tier_end < DATE '2024-02-01' AND tier <> 'bronze'
                THEN 'bronze' ELSE tier END AS tier,
           CASE WHEN tier_end IS NOT NULL AND tier_end < DATE '2024-02-01' AND tier <> 'bronze'
                THEN NULL ELSE tier_end END AS tier_end
    FROM ({USERS}) u
""", {"user_id": "i", "tier": "s", "tier_end": "day"})

ORACLE["register_users"] = q.select("""
    WITH names AS (
      SELECT DISTINCT c_name AS username FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)
      UNION SELECT s_name FROM supplier)
    SELECT c.c_custkey AS user_id, n.username, FALSE AS created
    FROM names n JOIN customer c ON c.c_name = n.username
    UNION ALL
    SELECT (SELECT coalesce(max(c_custkey), 0) FROM customer) + row_number() OVER (ORDER BY username) AS user_id,
           username, TRUE AS created
    FROM names WHERE username NOT IN (SELECT c_name FROM customer)
""", {"user_id": "i", "username": "s", "created": "i"})

ORACLE["monthly_active_users"] = q.select("""
    SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(DISTINCT o_custkey) AS active_users
    FROM orders GROUP BY 1
""", {"month": "day", "active_users": "i"})

ORACLE["cohort_retention"] = q.select("""
    WITH um AS (SELECT DISTINCT o_custkey AS user_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS month
                FROM orders),
    f AS (SELECT user_id, min(month) AS cohort FROM um GROUP BY user_id),
    cs AS (SELECT cohort, count(*) AS cohort_size FROM f GROUP BY cohort)
    SELECT f.cohort, datediff('month', f.cohort, um.month) AS months_since, count(*) AS active_users,
           cs.cohort_size, count(*) / cs.cohort_size AS retention
    FROM um JOIN f ON um.user_id = f.user_id JOIN cs ON cs.cohort = f.cohort
    GROUP BY f.cohort, months_since, cs.cohort_size
""", {"cohort": "day", "months_since": "i", "active_users": "i", "cohort_size": "i", "retention": "d"})


# --- publish, pivots, text ---------------------------------------------------------

ORACLE["publish_upsert"] = q.select(f"""
    WITH h AS ({HOURLY}),
    old AS (SELECT *, 1 AS version FROM h WHERE date < DATE '2024-01-20'),
    new AS (SELECT *, 2 AS version FROM h WHERE date >= DATE '2024-01-15')
    SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.location_id = old.location_id
                                          AND new.date = old.date AND new.hour = old.hour)
    UNION ALL SELECT * FROM new
""", {"date": "day", "hour": "i", "location_id": "s", "trips_count": "i", "version": "i"})
ORACLE["publish_append"] = q.select(f"""
    WITH h AS ({HOURLY})
    SELECT *, 1 AS version FROM h WHERE date < DATE '2024-01-20'
    UNION ALL SELECT *, 2 AS version FROM h WHERE date >= DATE '2024-01-15'
""", {"date": "day", "hour": "i", "location_id": "s", "trips_count": "i", "version": "i"})

ORACLE["error_matrix_wide"] = q.select(
    f"SELECT model, location_id, "
    + ", ".join(f"max(CASE WHEN step = {k} THEN mae END) AS step_{k:02d}" for k in range(24))
    + f" FROM (SELECT model, location_id, step, avg(abs(y - p)) AS mae FROM ({PREDS}) pr GROUP BY ALL) m"
    + " GROUP BY model, location_id",
    {"model": "s", "location_id": "s", **{f"step_{k:02d}": "d" for k in range(24)}})
ORACLE["demand_heatmap"] = q.select(
    "SELECT location_id, "
    + ", ".join(f"sum(CASE WHEN hour = {k} THEN trips_count END) AS h_{k:02d}" for k in range(24))
    + f" FROM ({HOURLY}) h GROUP BY location_id",
    {"location_id": "s", **{f"h_{k:02d}": "i" for k in range(24)}})

_PP = f"""
    WITH p AS ({_scaler_sql()}),
    y AS (SELECT mean AS my, scale AS sy FROM p WHERE feature = 'y')
    SELECT seq_no, origin_hour,
           CAST(ceil(greatest(((window_mean - my) / sy) * sy + my, 0.0) - 1e-9) AS BIGINT) AS d
    FROM ({WINDOWS}) w CROSS JOIN y WHERE split = 'test'
"""
_LINE = ("'🕒 ' || lpad(CAST(((origin_hour + t.step - 8) % 24 + 24) % 24 AS VARCHAR), 2, '0') "
         "|| ':00 - 🚗 ' || CAST(d AS VARCHAR) || ' поездок'")
ORACLE["forecast_text"] = q.select(f"""
    SELECT seq_no, '[' || string_agg(CAST(d AS VARCHAR), ', ' ORDER BY t.step) || ']' AS result,
           string_agg({_LINE}, chr(10) ORDER BY t.step) AS message
    FROM ({_PP}) x CROSS JOIN range(24) AS t(step)
    GROUP BY seq_no
""", {"seq_no": "i", "result": "s", "message": "s"})

ORACLE["forecast_decoded"] = q.select(f"""
    SELECT seq_no, t.step, CAST(d AS DOUBLE) AS demand FROM ({_PP}) x CROSS JOIN range(24) AS t(step)
""", {"seq_no": "i", "step": "i", "demand": "d"})

MESSAGES = f"""
    SELECT r.request_id AS prediction_id, r.user_id, 'lstmv3' AS model, r.location_id AS district,
           (hour(r.target_ts) + 1) % 24 AS hour, 'NYC' AS city,
           CASE WHEN r.request_id % 4 = 0 THEN 0.0 ELSE
           CASE coalesce(u.tier, 'bronze') WHEN 'bronze' THEN 20.0 WHEN 'silver' THEN 15.0
                WHEN 'gold' THEN 10.0 ELSE 5.0 END END AS cost,
           year(r.target_ts + INTERVAL 1 HOUR) AS year, month(r.target_ts + INTERVAL 1 HOUR) AS month,
           day(r.target_ts + INTERVAL 1 HOUR) AS day,
           make_timestamp(2024, month(r.target_ts + INTERVAL 1 HOUR), day(r.target_ts + INTERVAL 1 HOUR),
                          (hour(r.target_ts) + 1) % 24, 0, 0) AS target
    FROM ({REQUESTS}) r LEFT JOIN ({USERS}) u ON r.user_id = u.user_id
"""
ORACLE["request_messages"] = q.select(MESSAGES, {"prediction_id": "i", "user_id": "i", "model": "s", "district": "s", "hour": "i", "city": "s",
      "cost": "d", "year": "i", "month": "i", "day": "i", "target": "ts"})


# --- streaming mirrors of batch operators --------------------------------------------

ORACLE["stream_hourly_demand"] = ORACLE["hourly_demand"]
ORACLE["stream_daily_quota"] = ORACLE["daily_quota"]
ORACLE["stream_publish"] = ORACLE["publish_upsert"]


_PRICE_U = ("CASE WHEN x.request_id % 4 = 0 THEN 0.0 ELSE CASE coalesce(u.tier, 'bronze') WHEN 'bronze' THEN 20.0 "
            "WHEN 'silver' THEN 15.0 WHEN 'gold' THEN 10.0 ELSE 5.0 END END")
_RESULTS = f"""
    SELECT x.request_id AS prediction_id, r.user_id, x.target_ts AS ts, {_PRICE_U} AS cost,
           x.status = 'ok' AS scored
    FROM ({RESOLVED}) x JOIN ({REQUESTS}) r ON r.request_id = x.request_id
    LEFT JOIN ({USERS}) u ON u.user_id = r.user_id
"""


def _lifecycle_ops(results: str) -> str:
    return f"""
    SELECT user_id, op_id, ts, kind, amount_cents,
           row_number() OVER (PARTITION BY user_id ORDER BY ts, op_id) AS rn
    FROM (
      SELECT o_custkey AS user_id, o_orderkey AS op_id, o_orderdate AS ts,
             CASE WHEN o_orderstatus = 'F' THEN 'deposit' ELSE 'withdraw' END AS kind, {CENTS} AS amount_cents
      FROM orders
      UNION ALL
      SELECT user_id, -prediction_id - 1, ts, 'withdraw', CAST(floor(cost * 100 + 0.5) AS BIGINT)
      FROM ({results}) c WHERE scored AND cost <> 0
    ) a
"""


ORACLE["request_lifecycle"] = q.select(f"""
    WITH rep AS ({_replay_sql(_lifecycle_ops(_RESULTS))}),
    res AS ({_RESULTS})
    SELECT res.prediction_id, res.user_id, res.cost,
           CASE WHEN NOT res.scored THEN 'failed'
                WHEN res.cost <> 0 AND NOT coalesce(rep.accepted, FALSE) THEN 'failed'
                ELSE 'completed' END AS status,
           rep.accepted AS charged, rep.balance_cents AS balance_after_cents
    FROM res LEFT JOIN rep ON rep.op_id = -res.prediction_id - 1
""", {"prediction_id": "i", "user_id": "i", "cost": "d", "status": "s", "charged": "i",
      "balance_after_cents": "i"})


_AT = "TIMESTAMP '2030-01-01 00:00:00' + INTERVAL 1 HOUR * (n - 1)"
ORACLE["request_transitions"] = q.select(f"""
    WITH rep AS ({_replay_sql(_lifecycle_ops(_RESULTS))}),
    res AS (SELECT *, CASE WHEN prediction_id % 49 = 0 THEN 3 WHEN prediction_id % 7 = 0 THEN 2 ELSE 1 END AS tries
            FROM ({_RESULTS}) x),
    turns AS (SELECT res.*, n FROM res CROSS JOIN range(1, 4) AS t(n) WHERE n <= tries),
    steps AS (
      SELECT prediction_id, 'pending' AS status, ts, 0 AS attempt, NULL AS reason, 0 AS pos FROM res
      UNION ALL
      SELECT prediction_id, 'processing', {_AT}, n, NULL, 1 FROM turns
      UNION ALL
      SELECT prediction_id, 'pending', {_AT} + INTERVAL 1 HOUR, n, 'timeout', 2 FROM turns WHERE n < tries
      UNION ALL
      SELECT prediction_id, CASE WHEN scored THEN 'completed' ELSE 'failed' END, {_AT} + INTERVAL 5 MINUTE, n,
             CASE WHEN NOT scored THEN 'not_scored' END, 2
      FROM turns WHERE n = tries
      UNION ALL
      SELECT res.prediction_id, 'failed', TIMESTAMP '2030-01-01 03:00:00', tries, 'charge_rejected', 3
      FROM res LEFT JOIN rep ON rep.op_id = -res.prediction_id - 1
      WHERE scored AND cost <> 0 AND NOT coalesce(rep.accepted, FALSE)
    )
    SELECT prediction_id, row_number() OVER (PARTITION BY prediction_id ORDER BY attempt, pos) AS step,
           status, ts, attempt, reason
    FROM steps
""", {"prediction_id": "i", "step": "i", "status": "s", "ts": "ts", "attempt": "i", "reason": "s"})


_TPRICE = ("CASE {t} WHEN 'bronze' THEN 0 WHEN 'silver' THEN 10000 WHEN 'gold' THEN 20000 "
           "WHEN 'diamond' THEN 50000 END")
_TIER_OPS = f"""
    SELECT o_custkey AS user_id, o_orderkey AS op_id, CAST(o_orderdate AS DATE) AS day,
           CASE o_orderstatus WHEN 'F' THEN 'deposit' WHEN 'O' THEN 'withdraw' ELSE 'tier' END AS kind,
           {CENTS} AS amount_cents,
           CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN
             CASE o_orderpriority WHEN '1-URGENT' THEN 'diamond' WHEN '2-HIGH' THEN 'gold'
                                  WHEN '3-MEDIUM' THEN 'silver' ELSE 'bronze' END END AS level,
           row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn
    FROM orders
"""
_STEP = f"""
    SELECT user_id, rn, op_id, kind, level, bal, t0, e0, day, amount_cents,
      CASE kind
        WHEN 'deposit' THEN amount_cents > 0
        WHEN 'withdraw' THEN amount_cents >= 0 AND amount_cents <= bal
        ELSE {_TPRICE.format(t='level')} IS NOT NULL
             AND {_TPRICE.format(t='t0')} <= {_TPRICE.format(t='level')}
             AND bal >= {_TPRICE.format(t='level')} END AS accepted,
      CASE kind
        WHEN 'deposit' THEN CASE WHEN amount_cents > 0 THEN NULL ELSE 'non_positive_deposit' END
        WHEN 'withdraw' THEN CASE WHEN amount_cents < 0 THEN 'negative_withdrawal'
                                  WHEN amount_cents > bal THEN 'insufficient_funds' END
        ELSE CASE WHEN {_TPRICE.format(t='level')} IS NULL THEN 'unknown_tier'
                  WHEN {_TPRICE.format(t='t0')} > {_TPRICE.format(t='level')} THEN 'tier_step_down'
                  WHEN bal < {_TPRICE.format(t='level')} THEN 'insufficient_funds' END END AS reason
    FROM (
      SELECT o.user_id, o.rn, o.op_id, o.kind, o.level, o.day, o.amount_cents, r.balance_cents AS bal,
             CASE WHEN r.tier_end IS NOT NULL AND r.tier_end < o.day AND r.tier <> 'bronze'
                  THEN 'bronze' ELSE r.tier END AS t0,
             CASE WHEN r.tier_end IS NOT NULL AND r.tier_end < o.day AND r.tier <> 'bronze'
                  THEN NULL ELSE r.tier_end END AS e0
      FROM r JOIN ops o ON o.user_id = r.user_id AND o.rn = r.rn + 1
    ) x
"""
ORACLE["tier_replay"] = q.select(f"""
    WITH RECURSIVE ops AS ({_TIER_OPS}),
    r AS (
      SELECT DISTINCT user_id, 0 AS rn, CAST(NULL AS BIGINT) AS op_id, CAST(NULL AS VARCHAR) AS kind,
             CAST(NULL AS VARCHAR) AS level, CAST(NULL AS BOOLEAN) AS accepted, CAST(NULL AS VARCHAR) AS reason,
             CAST(0 AS BIGINT) AS balance_cents, 'bronze' AS tier, CAST(NULL AS DATE) AS tier_end
      FROM ops
      UNION ALL
      SELECT user_id, rn, op_id, kind, level, accepted, reason,
             CASE WHEN NOT accepted THEN bal
                  WHEN kind = 'deposit' THEN bal + amount_cents
                  WHEN kind = 'withdraw' THEN bal - amount_cents
                  ELSE bal - {_TPRICE.format(t='level')} END,
             CASE WHEN accepted AND kind = 'tier' THEN level ELSE t0 END,
             CASE WHEN accepted AND kind = 'tier' THEN
                    CASE WHEN t0 = level AND e0 IS NOT NULL AND e0 >= day THEN e0 + 30 ELSE day + 30 END
                  ELSE e0 END
      FROM ({_STEP}) s
    )
    SELECT user_id, op_id, kind, level, accepted, reason, balance_cents, tier, tier_end FROM r WHERE rn > 0
""", {"user_id": "i", "op_id": "i", "kind": "s", "level": "s", "accepted": "i", "reason": "s",
      "balance_cents": "i", "tier": "s", "tier_end": "day"})

ORACLE["stream_ledger"] = ORACLE["tier_replay"]


# --- scored messages -------------------------------------------------------------------

_ASKED = f"SELECT prediction_id AS request_id, user_id, district AS location_id, cost, target AS target_ts FROM ({MESSAGES}) m"
_FORECASTS = f"""
    WITH p AS ({_scaler_sql()}),
    y AS (SELECT mean AS my, scale AS sy FROM p WHERE feature = 'y'),
    t AS (SELECT mean AS mt, scale AS st FROM p WHERE feature = 'trips_count'),
    s AS ({SERIES_TS}),
    zm AS (SELECT location_id, avg(CAST(trips_count AS DOUBLE)) AS m FROM s GROUP BY location_id),
    pos AS (SELECT request_id, location_id, asof_idx - 71 + r.pos AS src
            FROM ({_resolved(_ASKED)}) x CROSS JOIN range(72) AS r(pos) WHERE status = 'ok'),
    f AS (SELECT pos.request_id, avg((coalesce(CAST(s.trips_count AS DOUBLE), zm.m) - mt) / st) AS v
          FROM pos LEFT JOIN s ON s.location_id = pos.location_id AND s.time_idx = pos.src
          JOIN zm ON zm.location_id = pos.location_id CROSS JOIN t GROUP BY pos.request_id)
    SELECT request_id, '[' || rtrim(repeat(CAST(CAST(ceil(greatest(v * sy + my, 0.0) - 1e-9) AS BIGINT) AS VARCHAR) || ', ', 24), ', ')
                       || ']' AS result
    FROM f CROSS JOIN y
"""
ORACLE["priced_forecasts"] = q.select(f"""
    SELECT a.request_id, a.cost, f.result, CASE WHEN a.cost > 0 THEN 24 ELSE 0 END AS n_prices
    FROM ({_FORECASTS}) f JOIN ({_ASKED}) a ON a.request_id = f.request_id
""", {"request_id": "i", "cost": "d", "result": "s", "n_prices": "i"})
_SCORED = f"""
    SELECT a.request_id AS prediction_id, a.user_id, a.target_ts AS ts, a.cost, f.result IS NOT NULL AS scored, f.result,
           CASE WHEN f.result IS NOT NULL AND a.cost > 0 THEN 24 ELSE 0 END AS n_prices
    FROM ({_ASKED}) a LEFT JOIN ({_FORECASTS}) f ON a.request_id = f.request_id
"""
ORACLE["stream_request_scoring"] = q.select(f"""
    WITH res AS ({_SCORED}),
    rep AS ({_replay_sql(_lifecycle_ops(_SCORED))})
    SELECT res.prediction_id, res.user_id, res.ts, res.cost,
           CASE WHEN NOT res.scored THEN 'failed'
                WHEN res.cost <> 0 AND NOT coalesce(rep.accepted, FALSE) THEN 'failed'
                ELSE 'completed' END AS status,
           res.result, res.n_prices, rep.accepted AS charged, rep.balance_cents AS balance_after_cents
    FROM res LEFT JOIN rep ON rep.op_id = -res.prediction_id - 1
""", {"prediction_id": "i", "user_id": "i", "ts": "ts", "cost": "d", "status": "s", "result": "s", "n_prices": "i",
      "charged": "i", "balance_after_cents": "i"})

_COST_ROWS = """
    SELECT location_id, date, hour, trips_count, avg_cost_per_mile,
           CASE WHEN u < 0.2 THEN 'test' WHEN u < 0.2 + (1 - 0.2) * 0.25 THEN 'val' ELSE 'train' END AS split
    FROM (
      SELECT *, CAST('0x' || substr(md5(location_id || '|' || CAST(date AS VARCHAR) || '|' || CAST(hour AS VARCHAR) || '|42'), 1, 8)
                     AS BIGINT) / 4294967296.0 AS u
      FROM (
        SELECT location_id, CAST(pickup_ts AS DATE) AS date, hour(pickup_ts) AS hour, count(*) AS trips_count,
               avg(cost_per_mile) AS avg_cost_per_mile
        FROM (SELECT DISTINCT ts AS pickup_ts, event_type AS location_id, value / CAST(user_id % 10 + 1 AS DOUBLE) AS cost_per_mile
              FROM events WHERE value > 0 AND value / CAST(user_id % 10 + 1 AS DOUBLE) < 100.0 AND ts IS NOT NULL
                AND event_type IS NOT NULL) t
        GROUP BY ALL) h
    ) x
"""
ORACLE["cost_training_rows"] = q.select(_COST_ROWS, {"location_id": "s", "date": "day", "hour": "i", "trips_count": "i", "avg_cost_per_mile": "d9", "split": "s"})

# a node table that walks every row to another value than the model shows as a smaller n_agree
ORACLE["cost_tree_agreement"] = q.select(f"""
    SELECT location_id, hour, count(*) AS n, count(*) AS n_agree FROM ({_COST_ROWS}) r WHERE split = 'test' GROUP BY ALL
""", {"location_id": "s", "hour": "i", "n": "i", "n_agree": "i"})

_MODEL = "CASE request_id % 5 WHEN 0 THEN 'last_value' WHEN 1 THEN 'withdrawn' ELSE 'moving_average' END"
_LAST_VALUES = _FORECASTS.replace("WHERE status = 'ok'", "WHERE status = 'ok' AND r.pos = 71")
ORACLE["forecasts_by_model"] = q.select(f"""
    SELECT x.request_id, {_MODEL.replace('request_id', 'x.request_id')} AS model,
           CASE WHEN x.status <> 'ok' THEN x.status WHEN x.request_id % 5 = 1 THEN 'unknown_model' ELSE 'ok' END AS status,
           CASE WHEN x.request_id % 5 = 0 THEN l.result WHEN x.request_id % 5 > 1 THEN f.result END AS result
    FROM ({_resolved(_ASKED)}) x LEFT JOIN ({_FORECASTS}) f ON f.request_id = x.request_id
    LEFT JOIN ({_LAST_VALUES}) l ON l.request_id = x.request_id
""", {"request_id": "i", "model": "s", "status": "s", "result": "s"})

_COST_LINES = """
    SELECT location_id, hour,
           CASE WHEN coalesce(var_pop(trips_count), 0) = 0 THEN 0.0 ELSE regr_slope(avg_cost_per_mile, CAST(trips_count AS DOUBLE)) END AS slope,
           CASE WHEN coalesce(var_pop(trips_count), 0) = 0 THEN avg(avg_cost_per_mile)
                ELSE regr_intercept(avg_cost_per_mile, CAST(trips_count AS DOUBLE)) END AS intercept
    FROM (SELECT location_id, hour(pickup_ts) AS hour, count(*) AS trips_count, avg(cost_per_mile) AS avg_cost_per_mile
          FROM (SELECT DISTINCT ts AS pickup_ts, event_type AS location_id, value / CAST(user_id % 10 + 1 AS DOUBLE) AS cost_per_mile
                FROM events WHERE value > 0 AND value / CAST(user_id % 10 + 1 AS DOUBLE) < 100.0 AND ts IS NOT NULL
                  AND event_type IS NOT NULL) t
          GROUP BY location_id, CAST(pickup_ts AS DATE), hour(pickup_ts)) h
    GROUP BY location_id, hour
"""
_PRICED_HOURS = f"""
    SELECT a.request_id, s.step, hour(a.target_ts) AS start, CAST(trim(split_part(trim(f.result, '[]'), ',', 1)) AS BIGINT) AS d,
           round_even(greatest(c.intercept + c.slope * CAST(trim(split_part(trim(f.result, '[]'), ',', 1)) AS DOUBLE), 0.0), 2) AS price
    FROM ({_FORECASTS}) f JOIN ({_ASKED}) a ON a.request_id = f.request_id CROSS JOIN range(24) AS s(step)
    LEFT JOIN ({_COST_LINES}) c ON c.location_id = a.location_id AND c.hour = (hour(a.target_ts) + s.step) % 24
    WHERE a.cost > 0
"""
ORACLE["forecast_price_lines"] = q.select(f"""
    SELECT request_id, '[' || string_agg(CAST(price AS VARCHAR), ', ' ORDER BY step) || ']' AS prices,
           string_agg(chr(128338) || ' ' || lpad(CAST((start + step + 16) % 24 AS VARCHAR), 2, '0') || ':00 - ' || chr(128663) || ' '
                      || CAST(d AS VARCHAR) || ' поездок, ' || chr(128176) || ' ' || printf('%.2f', price) || ' $ per mile',
                      chr(10) ORDER BY step) AS message
    FROM ({_PRICED_HOURS}) h GROUP BY request_id
""", {"request_id": "i", "prices": "s", "message": "s"})


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
