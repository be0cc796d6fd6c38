"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
operator of the inventory, each over whole tables of ``sf_dir``.

Every result passes through ``report`` so column types and rounding match
the DuckDB twin in ``oracle.py`` (same names, same presentation).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandlake import catalog
from demandlake.functions import calendar as cal
from demandlake.functions import text
from demandlake.streaming.requests import MESSAGE_SCHEMA
from demandlake.operators import features as feat
from demandlake.operators import ledger, metrics, profile, sequences, serving
from demandlake.operators.hourly import hourly_cost
from demandlake.operators.hourly import hourly_demand as hourly_demand_of
from demandlake.plans import daily, experiment, modeling
from demandlake.plans import streams as stream_jobs
from demandlake.plans import requests as requests_plan
from demandlake.sources import accounts, feeds, sinks, weather, whitelist
from demandlake.plans.refit import load as load_refit
from demandlake.plans.refit import refit
from demandlake.plans.report import report
from demandlake.session import stage_path

Query = Callable[[SparkSession, str], DataFrame]

HOURLY_SCHEMA = T.StructType([
    T.StructField("date", T.DateType()), T.StructField("hour", T.IntegerType()),
    T.StructField("location_id", T.StringType()), T.StructField("trips_count", T.LongType())])
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


# --- slice 1: clean -> hourly -> features ---------------------------------

@register("hourly_demand")
def q_hourly_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(daily.hourly(spark, sf_dir))


@register("hourly_features")
def q_hourly_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(daily.feature_table(spark, sf_dir))


@register("hourly_features_row_adjacency")
def q_hourly_features_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch variant: row adjacency, batch holiday spelling, bfill lags."""
    df = daily.feature_table(spark, sf_dir, adjacency="row", names="batch_exact", lag_fill="bfill")
    return report(df.select("date", "hour", "location_id", "is_holiday", "is_pre_holiday",
                            "is_post_holiday", "lag_1h", "lag_24h", "lag_168h"))


@register("time_lags")
def q_time_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(feat.with_time_lags(daily.hourly(spark, sf_dir)))


# --- sources, cleaning, unification (A, B) --------------------------------

UNIFY_START, UNIFY_END = "1995-01-01", "2024-02-01"
COST_START, COST_END = "1900-01-01", "9999-01-01"


@register("unified_trips")
def q_unified_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three feeds with different raw schemas -> (location_id, date, hour),
    per-feed dedup (batch job semantics)."""
    return report(feeds.unify_trips(spark, catalog.driver_feeds(sf_dir), UNIFY_START, UNIFY_END))


@register("unified_trips_global_dedup")
def q_unified_trips_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(feeds.unify_trips(spark, catalog.driver_feeds(sf_dir), UNIFY_START, UNIFY_END,
                                    dedup="global"))


def _cost_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of lineitem as priced trips: no cap, all zones."""
    return feeds.unify_costs(spark, [catalog.cost_feed(sf_dir)], COST_START, COST_END, cap=None)


@register("cost_filters")
def q_cost_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cost variant's own filters (B7-B10): zone whitelist and outlier
    cap, on a mapping whose ratios lie on both sides of the cap."""
    trips = feeds.unify_costs(spark, [catalog.capped_cost_feed(sf_dir)], COST_START, COST_END,
                              zones=whitelist.zone_whitelist(spark))
    return report(hourly_cost(trips))


@register("feeds_with_missing_columns")
def q_missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed that lacks a required column is skipped, the others are
    unified (A4)."""
    lacking = catalog.FeedSpec("customer", f"{sf_dir}/customer.parquet", {"c_mktsegment": catalog.ZONE}, "customer")
    return report(feeds.unify_trips(spark, [lacking, *catalog.driver_feeds(sf_dir)], UNIFY_START, UNIFY_END))


@register("text_timestamp_feed")
def q_text_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed whose timestamps are text, some of them unparseable (A5),
    through the reader with a time range: every seventh event has a broken
    time, staged in the shared folder."""
    path = stage_path(spark, f"text-feed-{uuid.uuid4().hex[:12]}")
    ts = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    catalog.load(spark, sf_dir, "events").select(
        F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("n/a "), ts)).otherwise(ts).alias("ts"), "event_type").write.parquet(path)
    spec = catalog.FeedSpec("text", path, catalog.EVENTS_FEED_RENAME)
    return report(feeds.unify_trips(spark, [spec], catalog.EVENTS_START, catalog.EVENTS_END))


@register("directory_listing")
def q_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-file scan of a folder tree (A8): events staged as a nested tree,
    with a hidden folder that the scan leaves out; rows per zone."""
    path = stage_path(spark, f"tree-{uuid.uuid4().hex[:12]}")
    ev = catalog.load(spark, sf_dir, "events").select("event_id", "event_type", F.month("ts").alias("m"))
    ev.where(F.col("event_type") != "view").write.parquet(f"{path}/a/b")
    ev.where(F.col("event_type") == "view").write.parquet(f"{path}/c")
    ev.write.parquet(f"{path}/_hidden")
    tree = feeds.read_directory(spark, path)
    return report(tree.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_rows")))


@register("hourly_cost")
def q_hourly_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(hourly_cost(_cost_trips(spark, sf_dir)))


@register("wide_feed_duplicates")
def q_wide_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union on the shared columns after harmonising names (A7), then the
    full-row duplicate count (B4)."""
    frames = [catalog.load(spark, sf_dir, t) for t in ("events", "orders", "lineitem")]
    wide = feeds.union_on_common_columns(frames, catalog.WIDE_RENAME)
    return report(profile.duplicate_count(wide))


@register("orders_out_of_range")
def q_out_of_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(profile.out_of_range(catalog.load(spark, sf_dir, "orders"), "o_orderdate",
                                       "1996-01-01", "2000-12-31"))


@register("trips_row_count")
def q_row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(profile.row_count(daily.clean_trips(spark, sf_dir)))


# Feed kinds by lower-case file-name substring, tested in order.
FEED_PATTERNS = (("events", "events"), ("orders", "orders"), ("lineitem", "lineitem"))


@register("feed_classification")
def q_feed_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-file scan of the data folder; each row's feed kind from its
    file name (A1, A2, A8); rows per kind."""
    df = (spark.read.option("pathGlobFilter", "*.parquet").parquet(*[
        f"{sf_dir}/{t}.parquet" for t in ("events", "orders", "lineitem")])
        .select(feeds.classify_feed(F.col("_metadata.file_name"), FEED_PATTERNS).alias("feed")))
    return report(df.groupBy("feed").agg(F.count(F.lit(1)).alias("n_rows")))


@register("hourly_csv_stage")
def q_csv_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage border as the batch job has it (A9, A10): hourly demand written
    as CSV into the shared folder and read back with an explicit schema."""
    path = stage_path(spark, f"hourly-csv-{uuid.uuid4().hex[:12]}")
    daily.hourly(spark, sf_dir).write.mode("overwrite").option("header", True).csv(path)
    return report(feeds.read_csv_typed(spark, path, HOURLY_SCHEMA))


@register("feature_stage_roundtrip")
def q_parquet_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature table materialised as parquet partitioned by date and read
    back (A9): partition pruning applies to later date filters."""
    path = stage_path(spark, f"features-{uuid.uuid4().hex[:12]}")
    out = daily.materialise(daily.feature_table(spark, sf_dir), path)
    return report(out.select(*feat.FEATURE_TABLE))


# --- profiles and exploratory aggregates (C) ------------------------------

@register("events_column_profile")
def q_column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(profile.column_profile(catalog.load(spark, sf_dir, "events")))


@register("weather_null_ratio")
def q_null_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(profile.null_ratio(daily.feature_table(spark, sf_dir), "temp"))


@register("user_value_counts")
def q_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(profile.value_counts(catalog.load(spark, sf_dir, "events"), "user_id", 10))


@register("events_nunique")
def q_nunique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(profile.n_unique(catalog.load(spark, sf_dir, "events"), ["user_id", "event_type"]))


@register("busiest_hours")
def q_busiest_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(profile.busiest_hours(catalog.load(spark, sf_dir, "events"), "ts", 10))


@register("rides_by_hour")
def q_rides_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(profile.total_by(daily.hourly(spark, sf_dir), "hour", name="total_rides"))


@register("rides_by_weekday")
def q_rides_by_weekday(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = daily.hourly(spark, sf_dir).withColumn("day_of_week", F.weekday("date"))
    return report(profile.total_by(h, "day_of_week", name="total_rides"))


@register("holiday_vs_regular")
def q_holiday_vs_regular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(profile.holiday_vs_regular(daily.feature_table(spark, sf_dir)))


@register("top_cost_zones")
def q_top_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(profile.top_by_total(hourly_cost(_cost_trips(spark, sf_dir)), "location_id", n=10))


@register("zone_feature_means")
def q_zone_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(profile.zone_means(daily.feature_table(spark, sf_dir), feat.SEQ_FEATURES))


# --- calendar, weather, stations (F9, A11, A12) ---------------------------

@register("holiday_calendar")
def q_holiday_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = catalog.load(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date"))
    return report(cal.dim_holiday(spark, orders))


@register("weather_hourly")
def q_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(daily.weather_table(spark, sf_dir))


@register("nearest_station")
def q_nearest_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    stations = weather.driver_stations(catalog.load(spark, sf_dir, "supplier"))
    return report(weather.nearest_station(stations))


# --- ordering helpers, samples (A14, D10) ---------------------------------

@register("feature_sample_head")
def q_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(sinks.sample_head(daily.feature_table(spark, sf_dir), ["location_id", "date", "hour"], 15))


@register("sorted_series")
def q_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series clustered by zone and sorted for storage (D9): rows per
    zone, and how many stand before an earlier hour of their zone (none)."""
    rows = feat.sorted_series(daily.hourly(spark, sf_dir), storage=True).withColumn("at", F.monotonically_increasing_id())
    before = F.lag(F.struct("date", "hour")).over(Window.partitionBy("location_id").orderBy("at"))
    rows = rows.withColumn("swapped", F.coalesce(before > F.struct("date", "hour"), F.lit(False)).cast("int"))
    return report(rows.groupBy("location_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("swapped").alias("n_swapped")))


@register("zone_index")
def q_zone_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(sequences.zone_index(daily.hourly(spark, sf_dir)))


# --- windows, scaling, baselines, evaluation (G, H, I) --------------------

WINDOW_COLS = ("seq_no", "location_id", "zone_idx", "origin", "origin_date", "origin_hour", "split")


@register("sequence_windows")
def q_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(experiment.feature_windows(spark, sf_dir).select(*WINDOW_COLS))


@register("window_targets")
def q_window_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = sequences.targets_long(experiment.feature_windows(spark, sf_dir))
    return report(t.select("seq_no", "step", "y"))


SCALER_COLS = ("feature", "n", "n_valid", "mean", "scale")
# The research notebook's six window features.
SIX_FEATURES = ("trips_count", "hour_sin", "hour_cos", "dow_sin", "dow_cos", "is_holiday")


@register("scaler_params")
def q_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(experiment.scaler(spark, sf_dir).select(*SCALER_COLS))


@register("scaler_params_six")
def q_scaler_six(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-feature variant (G2): rides, hour and weekday cycles, holiday."""
    return report(experiment.scaler(spark, sf_dir, feature_cols=SIX_FEATURES).select(*SCALER_COLS))


@register("scaler_params_merged")
def q_scaler_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(experiment.scaler_merged(spark, sf_dir).select(*SCALER_COLS))


@register("refit_scaler")
def q_refit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic refit (H8) on the whole series: the scaler it stores."""
    path = refit(spark, daily.stable_features(spark, sf_dir), stage_path(spark, f"models-{uuid.uuid4().hex[:12]}"))
    return report(load_refit(spark, path)[0].select(*SCALER_COLS))


@register("scaled_features")
def q_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(experiment.scaled_features(spark, sf_dir))


@register("baseline_forecasts")
def q_baseline_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = experiment.baseline_predictions(spark, sf_dir)
    return report(p.select("seq_no", "location_id", "step", "model", "y", "p"))


@register("baseline_metrics")
def q_baseline_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(experiment.model_metrics(spark, sf_dir))


@register("errors_by_hour")
def q_errors_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(experiment.errors_by_hour(spark, sf_dir))


@register("errors_by_origin_hour")
def q_errors_by_origin_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(experiment.errors_by_origin_hour(spark, sf_dir))


@register("errors_by_zone")
def q_errors_by_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(experiment.errors_by_zone(spark, sf_dir))


@register("error_matrix")
def q_error_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(experiment.error_matrix(spark, sf_dir))


@register("best_hours")
def q_best_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = experiment.errors_by_hour(spark, sf_dir)
    return report(metrics.best(h, "composite", 10, "hour_of_day", by=["model"])
                  .select("model", "rank", "hour_of_day", "composite"))


@register("best_zones")
def q_best_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = experiment.errors_by_zone(spark, sf_dir)
    return report(metrics.best(z, "mae", 10, "location_id", by=["model"])
                  .select("model", "rank", "location_id", "mae"))


# --- serving (E3, E4, G9-G11, J1-J4) ----------------------------------------

@register("serving_status")
def q_serving_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = serving.series_ts(daily.stable_features(spark, sf_dir))
    req = requests_plan.driver_requests(spark, sf_dir)
    out = serving.resolve_requests(series, req)
    return report(out.select("request_id", "location_id", "target_ts", "status", "asof_idx", "n_available"))


@register("serving_windows")
def q_serving_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(requests_plan.scaled_windows(spark, sf_dir))


@register("serving_windows_upto_target")
def q_serving_upto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imputation and padding with means of the rows up to the target."""
    return report(requests_plan.scaled_windows(spark, sf_dir, upto_target=True))


@register("cost_features")
def q_cost_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(serving.cost_features(daily.hourly(spark, sf_dir), daily.weather_table(spark, sf_dir)))


@register("post_processed_forecasts")
def q_post_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(requests_plan.post_processed(spark, sf_dir))


# --- accounts (K, D12) -------------------------------------------------------

@register("ledger_replay")
def q_ledger_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = accounts.movements(catalog.load(spark, sf_dir, "orders"), with_tiers=False)
    out = ledger.replay_ledger(ops)
    return report(out.select("user_id", "op_id", "kind", "amount_cents", "accepted", "balance_cents"))


@register("request_lifecycle")
def q_request_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchase requests processed by the serving path, paid by tier price
    and charged after completion through the ledger (J6)."""
    results = requests_plan.processed_requests(spark, sf_dir)
    ops = accounts.movements(catalog.load(spark, sf_dir, "orders"), with_tiers=False)
    out = ledger.request_lifecycle(results, ops)
    return report(out.select("prediction_id", "user_id", "cost", "status", "charged", "balance_after_cents"))


@register("request_transitions")
def q_request_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every status a request goes through, lost workers and rejected charges included."""
    return report(requests_plan.request_transitions(spark, sf_dir))


@register("tier_replay")
def q_tier_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = accounts.movements(catalog.load(spark, sf_dir, "orders"), with_tiers=True)
    out = ledger.replay_ledger(ops)
    return report(out.select("user_id", "op_id", "kind", "level", "accepted", "reason", "balance_cents",
                             "tier", "tier_end"))


def _accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = accounts.movements(catalog.load(spark, sf_dir, "orders"), with_tiers=False)
    out = ledger.replay_ledger(ops).where("accepted")
    return out.withColumn("signed_cents", F.when(F.col("kind") == "deposit", F.col("amount_cents")).otherwise(-F.col("amount_cents")))


@register("ledger_balances")
def q_ledger_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running balance over the accepted movements (K2): the replay has it."""
    return report(_accepted(spark, sf_dir).select("user_id", "op_id", "signed_cents", "balance_cents"))


@register("ledger_history")
def q_ledger_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five newest accepted movements of each user."""
    return report(ledger.history(_accepted(spark, sf_dir), 5).select("user_id", "position", "op_id", "ts", "signed_cents"))


@register("owner_lookup")
def q_owner_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner-scoped lookups (B13): every order asked for by its customer and
    by the next one, who gets nothing."""
    ops = accounts.movements(catalog.load(spark, sf_dir, "orders"), with_tiers=False)
    wanted = ops.select(F.explode(F.array("user_id", F.col("user_id") + 1)).alias("user_id"), "op_id")
    return report(ledger.owner_lookups(ops, wanted).select("user_id", "op_id", "kind", "amount_cents"))


@register("request_prices")
def q_request_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = accounts.users(catalog.load(spark, sf_dir, "customer"))
    return report(u.select("user_id", "tier", ledger.request_price(F.col("tier")).alias("price"),
                           ledger.tier_price(F.col("tier")).alias("tier_price")))


@register("daily_quota")
def q_daily_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    req = accounts.requests(catalog.load(spark, sf_dir, "events"))
    u = accounts.users(catalog.load(spark, sf_dir, "customer"))
    return report(ledger.quota(req, u).select("request_id", "user_id", "day", "tier", "paid", "passes"))


@register("affordability")
def q_affordability(spark: SparkSession, sf_dir: str) -> DataFrame:
    req = accounts.requests(catalog.load(spark, sf_dir, "events")).where(F.col("paid"))
    u = accounts.users(catalog.load(spark, sf_dir, "customer"))
    return report(ledger.affordability(req, u).select("request_id", "user_id", "tier", "price", "affordable"))


@register("tier_expiry")
def q_tier_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = accounts.users(catalog.load(spark, sf_dir, "customer"))
    return report(ledger.expire_tiers(u, F.to_date(F.lit("2024-02-01"))).select("user_id", "tier", "tier_end"))


@register("register_users")
def q_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registrations: every supplier name and every customer name with an
    order; known names keep their row, new ones get the next ids."""
    existing = accounts.users(catalog.load(spark, sf_dir, "customer"))
    cust = catalog.load(spark, sf_dir, "customer")
    with_orders = cust.join(catalog.load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")),
                            "c_custkey", "left_semi").select(F.col("c_name").alias("username"))
    supp = catalog.load(spark, sf_dir, "supplier").select(F.col("s_name").alias("username"))
    return report(ledger.register_users(existing, with_orders.unionByName(supp)))


@register("monthly_active_users")
def q_mau(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = catalog.load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"),
                                                      F.col("o_orderdate").alias("ts"))
    return report(ledger.monthly_active(o))


@register("cohort_retention")
def q_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = catalog.load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"),
                                                      F.col("o_orderdate").alias("ts"))
    return report(ledger.retention(o))


# --- publish, pivots, text (A13, I9, J7, F14-F18) ---------------------------

PUBLISH_KEYS = ("location_id", "date", "hour")


def _publish_parts(spark: SparkSession, sf_dir: str):
    """The published dataset holds hours before 2024-01-20 (version 1); the
    new run recomputes from 2024-01-15 on (version 2), overlapping 5 days."""
    trips = daily.clean_trips(spark, sf_dir)
    h = hourly_demand_of(trips)
    old = h.where(F.col("date") < F.to_date(F.lit("2024-01-20"))).withColumn("version", F.lit(1))
    new = h.where(F.col("date") >= F.to_date(F.lit("2024-01-15"))).withColumn("version", F.lit(2))
    return old, new


@register("publish_upsert")
def q_publish_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _publish_parts(spark, sf_dir)
    path = stage_path(spark, f"published-{uuid.uuid4().hex[:12]}")
    sinks.publish_sorted(sinks.publish_upsert(old, new, PUBLISH_KEYS), path)
    return report(spark.read.parquet(path))


@register("publish_append")
def q_publish_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _publish_parts(spark, sf_dir)
    return report(sinks.publish_append(old, new))


@register("error_matrix_wide")
def q_error_matrix_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = metrics.error_matrix_wide(experiment.error_matrix(spark, sf_dir))
    return report(wide.select("model", "location_id",
                              *[F.col(f"`{k}`").alias(f"step_{k:02d}") for k in range(24)]))


@register("demand_heatmap")
def q_demand_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zone x hour-of-day trips (the heat-map data, J7 / C7 by zone)."""
    h = daily.hourly(spark, sf_dir)
    wide = h.groupBy("location_id").pivot("hour", list(range(24))).agg(F.sum("trips_count"))
    return report(wide.select("location_id", *[F.col(f"`{k}`").alias(f"h_{k:02d}") for k in range(24)]))


@register("forecast_text")
def q_forecast_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Serving forecasts (ceil) of the test windows as stored text and as
    the hourly message lines (F15, F16)."""
    f = daily.stable_features(spark, sf_dir)
    pp = requests_plan.post_processed(spark, sf_dir, f)
    arr = pp.groupBy("seq_no").agg(F.sort_array(F.collect_list(F.struct("step", "p_ceil"))).alias("_s"))
    win = experiment.feature_windows(spark, sf_dir, f).select("seq_no", "origin_hour")
    out = arr.join(win, "seq_no").withColumn("demand", F.col("_s.p_ceil"))
    return report(out.select("seq_no", text.list_to_text(F.col("demand")).alias("result"),
                             text.format_forecast(F.col("origin_hour"), F.col("demand")).alias("message")))


@register("forecast_decoded")
def q_forecast_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored forecast texts decoded again (F15), one row per hour."""
    stored = q_forecast_text(spark, sf_dir).select("seq_no", text.text_to_list(F.col("result")).alias("demand"))
    return report(stored.select("seq_no", F.posexplode("demand").alias("step", "demand")))


@register("request_messages")
def q_request_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request messages (A17 body, F17) encoded to JSON and decoded again,
    with the target instant in the analogue year (F18)."""
    req = requests_plan.request_messages(spark, sf_dir)
    body = req.select(F.to_json(F.struct(*req.columns)).alias("body"))
    msg = body.select(F.from_json("body", MESSAGE_SCHEMA).alias("m")).select("m.*")
    return report(msg.withColumn("target", text.analogue_ts(F.col("month"), F.col("day"), F.col("hour"))))


# --- models (H4-H7, I12, J5): fitted models are checked by pytest ---------------

@register("cost_training_rows")
def q_cost_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the cost model is trained on (H6): cleaned hourly costs with
    their split (G4)."""
    return report(modeling.cost_training(spark, sf_dir).select("location_id", "date", "hour", "trips_count", "avg_cost_per_mile", "split"), digits=9)


@register("linear_forecast_metrics")
def q_linear_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(modeling.linear_metrics(spark, sf_dir))


@register("linear_residual_products")
def q_linear_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal equations of the linear forecaster (H4), checked on the training
    windows: shares of 0 to four digits for every step."""
    return report(modeling.linear_residuals(spark, sf_dir), digits=4)


@register("cost_tree_agreement")
def q_cost_tree_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cost model's node table against the cost model, on every test row (H6)."""
    return report(modeling.cost_tree_agreement(spark, sf_dir))


@register("cost_model_metrics")
def q_cost_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(modeling.cost_metrics(spark, sf_dir))


@register("priced_forecasts")
def q_priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = modeling.priced_forecasts(spark, sf_dir)
    return report(out.select("request_id", "cost", text.list_to_text(F.col("forecast")).alias("result"),
                             F.coalesce(F.size("trip_costs"), F.lit(0)).alias("n_prices")))


@register("forecasts_by_model")
def q_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models by name (H7): status and forecast of every request."""
    out = modeling.forecasts_by_model(spark, sf_dir)
    return report(out.select("request_id", "model", "status", text.list_to_text(F.col("forecast")).alias("result")))


@register("forecast_price_lines")
def q_price_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every price of every paid request (J5, F13) and its hour lines (F16)."""
    out = modeling.price_lines(spark, sf_dir)
    return report(out.select("request_id", text.list_to_text(F.col("trip_costs"), integral=False).alias("prices"),
                             text.format_forecast(F.col("start"), F.col("demand"), F.col("trip_costs")).alias("message")))


# --- streaming (L1-L4) ---------------------------------------------------------

@register("stream_hourly_demand")
def q_stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(stream_jobs.hourly_from_events(spark, sf_dir))


@register("stream_daily_quota")
def q_stream_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(stream_jobs.quota_from_events(spark, sf_dir))


@register("stream_publish")
def q_stream_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``version`` is 1 for hours of the initial dataset, 2 for hours that the
    stream has brought (whatever epoch was the last to touch them)."""
    out = stream_jobs.publish_from_events(spark, sf_dir)
    return report(out.withColumn("version", F.least("version", F.lit(2))))


@register("stream_ledger")
def q_stream_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balance and tier after every movement, from state (L3)."""
    out = stream_jobs.ledger_from_orders(spark, sf_dir)
    return report(out.select("user_id", "op_id", "kind", "level", "accepted", "reason", "balance_cents", "tier", "tier_end"))


@register("stream_request_scoring")
def q_stream_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stream_jobs.scoring_from_events(spark, sf_dir)
    return report(out.select("prediction_id", "user_id", "ts", "cost", "status", "result",
                             F.coalesce("n_prices", F.lit(0)).alias("n_prices"), "charged", "balance_after_cents"))


def queries() -> dict[str, Query]:
    return dict(REGISTRY)

