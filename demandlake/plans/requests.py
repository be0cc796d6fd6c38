"""Request scoring job bound to the driver tables: requests, as-of input
windows, scaling, post-processing (the worker's batch path)."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlake import catalog
from demandlake.functions import text
from demandlake.operators import baselines, ledger, lifecycle, scaling, serving
from demandlake.plans import daily, experiment
from demandlake.session import stage_path
from demandlake.sources import accounts

MINUTE = dt.timedelta(minutes=1)


def driver_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast requests: every purchase event asks for the demand of its
    user's home zone (the type of the user's first event) as of its time."""
    ev = catalog.load(spark, sf_dir, "events")
    home = ev.groupBy("user_id").agg(
        F.min_by("event_type", F.struct("ts", "event_id")).alias("location_id"))
    req = ev.where(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("request_id"), "user_id", F.col("ts").alias("target_ts"))
    return req.join(home, "user_id", "left")


def request_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request messages (A17, F17): the hour after the request's, its day,
    and the price - by tier for a paid request, else 0.  Three of four
    requests are paid (id not divisible by 4)."""
    users = accounts.users(catalog.load(spark, sf_dir, "customer"))
    y, m, d = text.request_day(F.col("target_ts"))
    paid = F.col("request_id") % 4 != 0
    price = ledger.request_price(F.coalesce(F.col("tier"), F.lit("bronze")))
    return driver_requests(spark, sf_dir).join(users.select("user_id", "tier"), "user_id", "left").select(
        F.col("request_id").alias("prediction_id"), "user_id", F.lit("lstmv3").alias("model"),
        F.col("location_id").alias("district"), text.next_hour(F.hour("target_ts")).alias("hour"), F.lit("NYC").alias("city"),
        F.when(paid, price).otherwise(F.lit(0.0)).alias("cost"), y.alias("year"), m.alias("month"), d.alias("day"))


def scaled_windows(spark: SparkSession, sf_dir: str, upto_target: bool = False) -> DataFrame:
    f = daily.stable_features(spark, sf_dir)
    series = serving.series_ts(f)
    params = scaling.to_dict(experiment.scaler(spark, sf_dir, features=f))
    return serving.serving_windows(series, driver_requests(spark, sf_dir), params, upto_target=upto_target)


def post_processed(spark: SparkSession, sf_dir: str, features: DataFrame | None = None) -> DataFrame:
    """Moving-average forecasts of the test windows taken through the y
    scaler and back, clipped and rounded both ways (J1 offline half-even,
    J2 serving ceil)."""
    f = features if features is not None else daily.stable_features(spark, sf_dir)
    params = scaling.to_dict(experiment.scaler(spark, sf_dir, features=f))
    my, sy = params["y"]
    win = experiment.feature_windows(spark, sf_dir, f).where(F.col("split") == "test")
    scaled = win.select("seq_no", baselines.repeat_forecast(
        (F.col("window_mean") - F.lit(my)) / F.lit(sy)).alias("p_scaled"))
    out = serving.post_process(scaled, "p_scaled", (my, sy), "half_even", "p_round")
    out = serving.post_process(out, "p_scaled", (my, sy), "ceil", "p_ceil")
    return out.select("seq_no", F.posexplode(F.arrays_zip("p_round", "p_ceil")).alias("step", "p")) \
              .select("seq_no", "step", F.col("p.p_round").alias("p_round"), F.col("p.p_ceil").alias("p_ceil"))



def processed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchase requests with what the serving path makes of them: price by
    the user's tier (three of four are paid) and whether a forecast is possible."""
    series = serving.series_ts(daily.stable_features(spark, sf_dir))
    st = serving.resolve_requests(series, driver_requests(spark, sf_dir))
    u = accounts.users(catalog.load(spark, sf_dir, "customer"))
    return st.join(u.select("user_id", "tier"), "user_id", "left").select(
        F.col("request_id").alias("prediction_id"), "user_id", F.col("target_ts").alias("ts"),
        F.when(F.col("request_id") % 4 != 0, ledger.request_price(F.coalesce(F.col("tier"), F.lit("bronze"))))
        .otherwise(F.lit(0.0)).alias("cost"), (F.col("status") == "ok").alias("scored"))


def request_transitions(spark: SparkSession, sf_dir: str, start: dt.datetime = dt.datetime(2030, 1, 1),
                        timeout: dt.timedelta = 30 * MINUTE, rounds: int = 3) -> DataFrame:
    """Every transition of every request (J6), through a log of events.

    Rounds an hour apart return what is stuck, claim what is pending, score it
    and write the results; then the completed paid requests are charged
    through the ledger, and rejected charges fail them.  The stand-in for lost
    workers: before the last round, the a-th delivery of a request whose id is
    a multiple of 7 to the power a writes its result an hour late, after the
    request went back; multiples of 5 deliver a result twice.
    """
    log = lifecycle.RequestLog(spark, stage_path(spark, f"requests-{uuid.uuid4().hex[:12]}"))
    asked = processed_requests(spark, sf_dir)
    results_path = stage_path(spark, f"results-{uuid.uuid4().hex[:12]}")
    asked.write.parquet(results_path)
    asked = spark.read.schema(asked.schema).parquet(results_path)
    log.append(0, lifecycle.made(asked))
    step = 1
    lost = F.col("prediction_id") % F.pow(F.lit(7), F.col("attempt")).cast("bigint") == 0
    late = None
    for turn in range(rounds):
        now = start + turn * 60 * MINUTE
        log.append(step, lifecycle.return_stuck(log.events(step), now, timeout))
        log.append(step + 1, lifecycle.claim(log.events(step + 1), now))
        taken = log.events(step + 2).where((F.col("event") == lifecycle.PROCESSING) & (F.col("ts") == F.lit(now)))
        done = taken.select("prediction_id", "attempt").join(asked.select("prediction_id", "scored"), "prediction_id")
        kept = done if turn == rounds - 1 else done.where(~lost)
        log.append(step + 2, lifecycle.finish(kept, now + 5 * MINUTE))
        again = lifecycle.finish(kept.where(F.col("prediction_id") % 5 == 0), now + 6 * MINUTE)
        log.append(step + 3, again if late is None else again.unionByName(lifecycle.finish(late, now + 2 * MINUTE)))
        late = done.where(lost)
        step += 4
    settled = lifecycle.state(log.events(step)).where(F.col("status") == lifecycle.COMPLETED).select("prediction_id")
    ops = accounts.movements(catalog.load(spark, sf_dir, "orders"), with_tiers=False)
    charged = ledger.request_lifecycle(asked.join(settled, "prediction_id", "left_semi"), ops)
    end = start + rounds * 60 * MINUTE
    log.append(step, lifecycle.reject_charges(log.events(step), charged.where(F.col("status") == "failed"), end))
    return lifecycle.transitions(log.events())
