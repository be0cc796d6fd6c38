"""Request life cycle as a log of transitions.

A request is ``pending`` when it is made, ``processing`` while a worker has
it, then ``completed`` or ``failed``; a completed one whose charge is rejected
becomes failed and keeps its result.  A worker that is lost writes nothing
more: after a time-out the request is pending again and the next attempt
takes it up.

Nothing is updated.  Every step appends events (prediction_id, event, attempt,
ts, reason) and the status is a fold over them by request:

* the events of one attempt count once, at their first time, so a redelivered
  event changes nothing;
* a result counts if its attempt was started and not returned before it: what a
  worker writes after its request went back is refused;
* the first attempt with a result that counts settles the request, later
  attempts (a message delivered again after its result) do not count;
* events of a request that was never made, with a null id, attempt, time or an
  unknown name, are ignored.

Attempt 0 is the making of the request.  Both aggregates fold partially
before the shuffle, so many events of one attempt are no hot key; a request
has one row per attempt after the first.  Steps are appended by one job at a
time, each into its own folder, which a repeated step rewrites.
"""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PENDING, PROCESSING, COMPLETED, FAILED = "pending", "processing", "completed", "failed"
EVENTS = T.StructType([
    T.StructField("prediction_id", T.LongType()), T.StructField("event", T.StringType()),
    T.StructField("attempt", T.IntegerType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("reason", T.StringType())])


class RequestLog:
    """The events in ``path``, one folder per step."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, step: int, events: DataFrame) -> None:
        events.select(*EVENTS.names).write.mode("overwrite").parquet(os.path.join(self.path, f"step={step}"))

    def events(self, before: int | None = None) -> DataFrame:
        """All events, or those of the steps below ``before``: what a step
        reads, so that a repeated step finds what it found the first time."""
        schema = T.StructType([*EVENTS.fields, T.StructField("step", T.IntegerType())])
        log = self.spark.read.schema(schema).parquet(self.path)
        return (log if before is None else log.where(F.col("step") < before)).drop("step")


def _event(name: str, ts: Column, attempt: Column, reason: Column | None = None) -> list[Column]:
    return [F.col("prediction_id").cast("bigint").alias("prediction_id"), F.lit(name).alias("event"),
            attempt.cast("int").alias("attempt"), ts.cast("timestamp_ntz").alias("ts"),
            (reason if reason is not None else F.lit(None)).cast("string").alias("reason")]


def made(requests: DataFrame, ts: str = "ts") -> DataFrame:
    """Events of new requests (prediction_id, ts)."""
    return requests.select(*_event(PENDING, F.col(ts), F.lit(0)))


def attempts(events: DataFrame) -> DataFrame:
    """One row per (request, attempt): started, completed, failed, returned,
    each with reason where it has one, and ``ended``, the time of the first
    result that counts (null: none)."""
    def first(event: str) -> Column:
        return F.min(F.when(F.col("event") == event, F.struct("ts", "reason")))

    usable = events.where(F.col("prediction_id").isNotNull() & F.col("ts").isNotNull() & (F.col("attempt") >= 0))
    one = usable.groupBy("prediction_id", "attempt").agg(
        first(PROCESSING)["ts"].alias("started"), first(COMPLETED).alias("completed"), first(FAILED).alias("failed"),
        first(PENDING).alias("returned"))

    def counts(result: str) -> Column:
        at = F.col(f"{result}.ts")
        return F.when((F.col("attempt") > 0) & (at >= F.col("started")) & F.coalesce(at < F.col("returned.ts"), F.lit(True)), F.col(result))

    one = one.withColumns({"completed": counts("completed"), "failed": counts("failed")})
    return one.withColumn("ended", F.least(F.col("completed.ts"), F.col("failed.ts")))


def state(events: DataFrame) -> DataFrame:
    """(prediction_id, status, ts, attempt, reason) of every request that was
    made; ``ts`` is the time of its last transition."""
    each = F.struct("attempt", "started", "completed", "failed", "returned")
    by_request = attempts(events).groupBy("prediction_id").agg(
        F.min(F.when(F.col("attempt") == 0, F.col("returned.ts"))).alias("_made"),
        F.min_by(each, F.when(F.col("ended").isNotNull(), F.col("attempt"))).alias("_settled"),
        F.max_by(each, F.when(F.col("started").isNotNull(), F.col("attempt"))).alias("_last"))
    done, last = F.col("_settled"), F.col("_last")

    def at(status: str, ts: Column, attempt: Column, reason: Column) -> Column:
        return F.struct(F.lit(status).alias("status"), ts.alias("ts"), attempt.cast("int").alias("attempt"),
                        reason.cast("string").alias("reason"))

    now = (F.when(done["failed"].isNotNull(), at(FAILED, done["failed"]["ts"], done["attempt"], done["failed"]["reason"]))
           .when(done.isNotNull(), at(COMPLETED, done["completed"]["ts"], done["attempt"], F.lit(None)))
           .when(last.isNull(), at(PENDING, F.col("_made"), F.lit(0), F.lit(None)))
           .when(last["returned"].isNotNull(), at(PENDING, last["returned"]["ts"], last["attempt"], last["returned"]["reason"]))
           .otherwise(at(PROCESSING, last["started"], last["attempt"], F.lit(None))))
    return by_request.where(F.col("_made").isNotNull()).select("prediction_id", now.alias("_s")).select("prediction_id", "_s.*")


def claim(events: DataFrame, now: dt.datetime) -> DataFrame:
    """Events that give every pending request, new or returned, to a worker."""
    waiting = state(events).where((F.col("status") == PENDING) & (F.col("ts") <= F.lit(now)))
    return waiting.select(*_event(PROCESSING, F.lit(now), F.col("attempt") + 1))


def return_stuck(events: DataFrame, now: dt.datetime, timeout: dt.timedelta) -> DataFrame:
    """Events that return requests in processing for ``timeout`` or longer."""
    stuck = state(events).where((F.col("status") == PROCESSING) & (F.col("ts") <= F.lit(now - timeout)))
    return stuck.select(*_event(PENDING, F.lit(now), F.col("attempt"), F.lit("timeout")))


def finish(results: DataFrame, now: dt.datetime) -> DataFrame:
    """Events of worked-off deliveries (prediction_id, attempt, scored)."""
    scored = F.coalesce(F.col("scored"), F.lit(False))
    good = results.where(scored).select(*_event(COMPLETED, F.lit(now), F.col("attempt")))
    return good.unionByName(results.where(~scored).select(*_event(FAILED, F.lit(now), F.col("attempt"), F.lit("not_scored"))))


def reject_charges(events: DataFrame, rejected: DataFrame, now: dt.datetime) -> DataFrame:
    """Events of completed requests whose charge was rejected (prediction_id)."""
    done = state(events).where(F.col("status") == COMPLETED)
    return done.join(rejected.select("prediction_id").distinct(), "prediction_id", "left_semi").select(
        *_event(FAILED, F.lit(now), F.col("attempt"), F.lit("charge_rejected")))


def transitions(events: DataFrame) -> DataFrame:
    """Every transition that counts: (prediction_id, step from 1, status, ts,
    attempt, reason), in the order in which the request went through them."""
    each = attempts(events)
    w = Window.partitionBy("prediction_id")
    settled = F.min(F.when(F.col("ended").isNotNull(), F.col("attempt"))).over(w)
    was_made = F.max(F.when(F.col("attempt") == 0, F.col("returned.ts"))).over(w)
    each = each.withColumns({"_settled": settled, "_made": was_made}).where(
        F.col("_made").isNotNull() & (F.col("_settled").isNull() | (F.col("attempt") <= F.col("_settled")))
        & ((F.col("attempt") == 0) | F.col("started").isNotNull()))

    def step(status: str, ts: Column, reason: Column) -> Column:
        return F.when(ts.isNotNull(), F.struct(F.lit(status).alias("status"), ts.alias("ts"), reason.cast("string").alias("reason")))

    over = F.col("_settled").isNull() | (F.col("attempt") < F.col("_settled"))
    steps = F.array_compact(F.array(
        F.when(F.col("attempt") > 0, step(PROCESSING, F.col("started"), F.lit(None))),
        step(COMPLETED, F.col("completed.ts"), F.lit(None)), step(FAILED, F.col("failed.ts"), F.col("failed.reason")),
        F.when(over, step(PENDING, F.col("returned.ts"), F.col("returned.reason")))))
    long = each.select("prediction_id", "attempt", F.posexplode(steps).alias("_at", "_s"))
    order = Window.partitionBy("prediction_id").orderBy("attempt", "_at")
    return long.select("prediction_id", F.row_number().over(order).alias("step"), "_s.status", "_s.ts", "attempt", "_s.reason")
