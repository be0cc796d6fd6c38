"""Request message stream (A17, L2): JSON messages -> as-of windows ->
forecast -> post-process -> status rows, idempotent per message."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandlake.functions import text
from demandlake.operators import models, serving
from demandlake.session import stage_path
from demandlake.sources import queue
from demandlake.sources.registry import ModelRegistry, Shipped

# Fields of one request message.
MESSAGE_SCHEMA = T.StructType([
    T.StructField("prediction_id", T.LongType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("model", T.StringType()),
    T.StructField("district", T.StringType()),
    T.StructField("hour", T.IntegerType()),
    T.StructField("city", T.StringType()),
    T.StructField("cost", T.DoubleType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("day", T.IntegerType()),
])


def request_stream(spark: SparkSession, path: str | None = None, max_files: int | None = None,
                   fmt: str = "json", options: dict | None = None) -> DataFrame:
    """Request messages (A17) parsed with a fixed schema; malformed fields
    become null instead of failing the stream.

    ``fmt='json'``: message files dropped into ``path`` (the queue folder).
    ``fmt='request_queue'``: the durable queue of ``sources.queue`` at ``path``,
    whose messages are acknowledged when a micro-batch is done.
    ``fmt='kafka'``: a topic, with ``options`` such as
    ``kafka.bootstrap.servers`` and ``subscribe``; needs the Kafka connector
    on the cluster's classpath.  Either way the offsets / file list are kept
    in the query checkpoint, so delivery is at-least-once and the sink
    below makes the effect exactly-once.
    """
    if fmt == "kafka":
        raw = spark.readStream.format("kafka").options(**(options or {})).load()
        return raw.select(F.from_json(F.col("value").cast("string"), MESSAGE_SCHEMA).alias("m")).select("m.*")
    if fmt == queue.NAME:
        return spark.readStream.format(queue.register(spark)).schema(MESSAGE_SCHEMA).options(**(options or {})).option("path", path).load()
    reader = spark.readStream.schema(MESSAGE_SCHEMA).options(**(options or {}))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def score_batch(batch: DataFrame, series: DataFrame, params: dict, predict_fn: Callable | Shipped,
                y_params: tuple[float, float], epoch: int, price: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One micro-batch of messages -> status rows (J3, H7, J2, F15, G11) with
    the forecast of ``predict_fn`` (or of the model that each message names,
    if it is the shipped models of a registry) and, for requests that cost something, the price of every
    forecast hour (J5).  ``price`` maps (request_id, location_id, target_ts,
    forecast, cost) to (request_id, trip_costs)."""
    req = batch.dropDuplicates(["prediction_id"]).select(
        F.col("prediction_id").alias("request_id"), "user_id", F.col("district").alias("location_id"),
        "model", F.coalesce("cost", F.lit(0.0)).alias("cost"),
        text.analogue_ts(F.col("month"), F.col("day"), F.col("hour")).alias("target_ts"))
    # the messages are read and resolved once, the joins below read what was written
    stage = stage_path(batch.sparkSession, f"resolved-{uuid.uuid4().hex[:12]}")
    found = serving.resolve_requests(series, req)
    found.write.parquet(stage)
    resolved = batch.sparkSession.read.schema(found.schema).parquet(stage)
    if isinstance(predict_fn, Shipped):
        scored = serving.request_forecasts(series, resolved, lambda x, keys: models.score_by_name(x, predict_fn, keys),
                                           params, by=("model",)).drop("model_status")
    else:
        scored = serving.request_forecasts(series, resolved, lambda x, keys: models.score_sequences(x, predict_fn, keys, horizon=24), params)
    done = serving.post_process(scored, "forecast", y_params, rounding="ceil")
    rows = resolved.select("request_id", "user_id", "location_id", "target_ts", "cost", "status").join(done, "request_id", "left")
    if price is not None:
        rows = rows.join(price(rows.where(F.col("forecast").isNotNull())), "request_id", "left")
    else:
        rows = rows.withColumn("trip_costs", F.lit(None).cast("array<double>"))
    return rows.select(
        F.col("request_id").alias("prediction_id"), "user_id", F.col("target_ts").alias("ts"), "cost",
        F.col("forecast").isNotNull().alias("scored"), text.list_to_text(F.col("forecast")).alias("result"),
        text.list_to_text(F.col("trip_costs"), integral=False).alias("trip_costs"),
        F.size("trip_costs").alias("n_prices"), F.lit(epoch).cast("long").alias("processed_epoch"))


def run_request_scoring(spark: SparkSession, messages: str, out: str, checkpoint: str,
                        series: DataFrame, params: dict, predict_fn: Callable | ModelRegistry,
                        price: Callable[[DataFrame], DataFrame] | None = None, fmt: str = queue.NAME) -> None:
    """Scoring stream (L2).  Each micro-batch writes its rows into
    ``out/epoch=<id>`` with overwrite: a replayed epoch after a failure
    rewrites the same folder, so the sink is idempotent; the checkpoint
    makes the source resume after the last committed epoch.  With a registry
    as ``predict_fn`` a message names its model, and an epoch uses the versions
    that are current when it starts.  Charging is a
    replay of the ledger with the scored paid requests in it
    (``ledger.request_lifecycle``), which readers of ``out`` run."""
    y_params = params["y"]

    def sink(batch: DataFrame, epoch: int) -> None:
        chosen = predict_fn.ship() if isinstance(predict_fn, ModelRegistry) else predict_fn
        rows = score_batch(batch, series, params, chosen, y_params, epoch, price)
        rows.write.mode("overwrite").parquet(os.path.join(out, f"epoch={epoch}"))

    q = (request_stream(spark, messages, fmt=fmt).writeStream.foreachBatch(sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def finished_requests(spark: SparkSession, out: str) -> DataFrame:
    """The scored requests, one row each (a message delivered again in a
    later epoch keeps its first result)."""
    rows = spark.read.parquet(out)
    first = rows.groupBy("prediction_id").agg(F.min("processed_epoch").alias("processed_epoch"))
    return rows.join(first, ["prediction_id", "processed_epoch"], "left_semi").drop("epoch", "processed_epoch")


def moving_average_model(x: np.ndarray) -> np.ndarray:
    """Example ``predict_fn``: mean of the (scaled) trips feature over the
    window, repeated over 24 steps; x has shape (n, 72, 24)."""
    m = x[:, :, 0].mean(axis=1)
    return np.repeat(m[:, None], 24, axis=1)



def last_value_model(x: np.ndarray) -> np.ndarray:
    """Example ``predict_fn``: the window's last (scaled) trips, repeated."""
    return np.repeat(x[:, -1:, 0], 24, axis=1)
