"""Streaming jobs bound to the driver tables.  Each run uses fresh folders
under the shared checkpoint directory for its checkpoint and sink, runs with
``trigger(availableNow=True)`` and returns the sink read back as a batch
DataFrame (so it can be compared with the batch operator it mirrors)."""

from __future__ import annotations

import contextlib
import datetime as dt
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlake import catalog
from demandlake.operators import ledger, scaling, serving
from demandlake.plans import daily, experiment, modeling, requests
from demandlake.session import checkpoint_dir
from demandlake.sources import accounts, queue
from demandlake.sources.registry import ModelRegistry
from demandlake.streaming import balances, hourly, quota
from demandlake.streaming import requests as req_stream

EVENTS_DELAY = "1 hour"


@contextlib.contextmanager
def stream_partitions(spark: SparkSession):
    """State partitions of a stateful stream are fixed when its checkpoint
    is created, from ``spark.sql.shuffle.partitions``.  They are sized to
    the cluster's parallelism (total executor cores) for the start of the
    stream, and the session setting is restored afterwards."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(max(1, spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _scratch(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex[:12]}")


def _events_stream(spark: SparkSession, sf_dir: str, start: str = catalog.EVENTS_START,
                   end: str = catalog.EVENTS_END) -> DataFrame:
    schema = catalog.load(spark, sf_dir, "events").schema
    raw = (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
           .option("maxFilesPerTrigger", 1).parquet(sf_dir))
    ts = F.col("ts")
    raw = raw.where((ts >= F.to_timestamp_ntz(F.lit(start))) & (ts < F.to_timestamp_ntz(F.lit(end))))
    return raw


def hourly_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _scratch(spark, "hourly")
    trips = _events_stream(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("pickup"),
                                                 F.col("event_type").alias("location_id"))
    with stream_partitions(spark):
        hourly.run_hourly(spark, trips, os.path.join(base, "out"), os.path.join(base, "ckpt"), EVENTS_DELAY)
    return hourly.hourly_table(spark, os.path.join(base, "out"), trips.schema["location_id"].dataType)


QUOTA_DELAY = "60 days"  # the day parts below arrive long after the other days' first parts


def quota_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quota stream fed in three parts: the first, second and third eight
    hours of every day, each as new files and one run of the stream, so every
    part interleaves all days."""
    base = _scratch(spark, "quota")
    ev = catalog.load(spark, sf_dir, "events")
    tiers = accounts.users(catalog.load(spark, sf_dir, "customer"))
    with stream_partitions(spark):
        for part in range(3):
            inbox = os.path.join(base, "in")
            ev.where(F.floor(F.hour("ts") / 8) == part).write.mode("append").parquet(inbox)
            raw = spark.readStream.schema(ev.schema).parquet(inbox)
            reqs = raw.select(F.col("event_id").alias("request_id"), "user_id", F.col("ts").cast("timestamp").alias("ts"),
                              (F.col("event_type") == "purchase").alias("paid"))
            decided = quota.run_quota(spark, reqs, tiers, base, os.path.join(base, "ckpt"), QUOTA_DELAY)
    return decided


LEDGER_DELAY = "800 days"  # movements come up to a year after their own year's file


def ledger_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger stream over deposits, withdrawals and tier purchases.  Each
    micro-batch holds the movements of a year (as many files as the cluster
    runs tasks at once), without a third of them that come a year late, with
    the late ones of the year before, and with a fifth of the year before
    delivered again.  A last file closes the books: one tick far behind the
    end."""
    base = _scratch(spark, "ledger")
    ops = accounts.movements(catalog.load(spark, sf_dir, "orders"), with_tiers=True).select(
        "user_id", "op_id", F.col("ts").cast("timestamp").alias("ts"), "kind", "amount_cents", "level")
    first, last = ops.agg(F.min(F.year("ts")), F.max(F.year("ts"))).first()
    inbox, late, again = os.path.join(base, "in"), F.pmod("op_id", F.lit(3)) == 0, F.pmod("op_id", F.lit(5)) == 0
    files = max(1, spark.sparkContext.defaultParallelism)
    for year in range(first, last + 2) if first else ():
        own, before = F.year("ts") == year, F.year("ts") == year - 1
        ops.where(own & ~late | before & (late | again)).repartition(files, "op_id").write.mode("append").parquet(inbox)
    tick = [(None, None, dt.datetime((last or 1970) + 9, 1, 1), "tick", 0, None)]
    spark.createDataFrame(tick, ops.schema).coalesce(1).write.mode("append").parquet(inbox)
    raw = spark.readStream.schema(ops.schema).option("maxFilesPerTrigger", files).parquet(inbox)
    with stream_partitions(spark):
        return balances.run_ledger(spark, raw, os.path.join(base, "out"), os.path.join(base, "ckpt"), LEDGER_DELAY)


PUBLISH_DAYS = 9       # days of events that arrive together, as PUBLISH_PARTS files
PUBLISH_PARTS = 4


def publish_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published dataset = hours before 2024-01-20 (version 1); the daily
    stream brings the events from 2024-01-15 on and upserts them (L4 = A13).
    The events arrive in files, one a micro-batch, and those of every hour in
    four of them."""
    base = _scratch(spark, "publish")
    published = os.path.join(base, "published")
    old = daily.hourly(spark, sf_dir).where(F.col("date") < F.to_date(F.lit("2024-01-20")))
    hourly.publish_dates(old.withColumn("version", F.lit(1)), published, 1)
    ts = F.col("ts")
    ev = catalog.load(spark, sf_dir, "events").where(
        (ts >= F.to_timestamp_ntz(F.lit("2024-01-15"))) & (ts < F.to_timestamp_ntz(F.lit(catalog.EVENTS_END)))).select("event_id", "ts", "event_type")
    inbox, day = os.path.join(base, "in"), F.datediff(F.to_date("ts"), F.lit("2024-01-15"))
    last = ev.agg(F.max(day)).first()[0]
    for chunk in range(0, (last or 0) + 1, PUBLISH_DAYS):
        for part in range(PUBLISH_PARTS):
            (ev.where(day.between(chunk, chunk + PUBLISH_DAYS - 1) & (F.pmod("event_id", F.lit(PUBLISH_PARTS)) == part))
             .coalesce(1).write.mode("append").parquet(inbox))
    raw = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    trips = raw.select(F.col("ts").cast("timestamp").alias("pickup"), F.col("event_type").alias("location_id"))
    with stream_partitions(spark):
        return hourly.run_incremental_publish(spark, trips, published, os.path.join(base, "ckpt"), f"{PUBLISH_DAYS + 1} days")


def scoring_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request messages (sent through the queue) scored and priced
    by the streaming worker (L2), then charged through the ledger (J6)."""
    base = _scratch(spark, "scoring")
    msgs = os.path.join(base, "queue")
    requests.request_messages(spark, sf_dir).write.format(queue.register(spark)).mode("append").option("path", msgs).save()
    f = daily.stable_features(spark, sf_dir)
    series = serving.series_ts(f)
    params = scaling.to_dict(experiment.scaler(spark, sf_dir, features=f))
    out = os.path.join(base, "status")
    models = ModelRegistry(spark, os.path.join(base, "models"))
    models.publish("lstmv3", req_stream.moving_average_model)     # the model that the messages name
    req_stream.run_request_scoring(spark, msgs, out, os.path.join(base, "ckpt"), series, params,
                                   models, modeling.pricer(spark, sf_dir))
    ops = accounts.movements(catalog.load(spark, sf_dir, "orders"), with_tiers=False)
    return ledger.request_lifecycle(req_stream.finished_requests(spark, out), ops)
