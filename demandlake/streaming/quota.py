"""Streaming daily quota per user (L3, K5).

A free request passes iff it is within the first ``quota(tier)`` requests of
its user and UTC day, paid ones counted too; diamond is unlimited.  Duplicate
deliveries of a request id are dropped within the watermark.

Per micro-batch, all in the JVM: the requests of a user and day so far are a
sum of increments (``increments``, one row per user and day that has any);
the batch's own requests are ranked in (ts, id) order behind them.  Ranks
beyond the largest quota do not matter, so the rank is a literal group limit
that cuts a hot user's rows before the shuffle.  The epoch's decisions and its
increment are rewritten by a replay, which sees the sums below its epoch only.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandlake.operators.ledger import MAX_QUOTA, daily_quota
from demandlake.operators.ordered import top_n_per_key
from demandlake.streaming.increments import Increments

DAY = T.StructType([T.StructField("day", T.DateType()), T.StructField("user_id", T.LongType())])
OUT = ["request_id", "user_id", "day", "tier", "paid", "passes"]


def decide(batch: DataFrame, tiers: DataFrame, counts: Increments, epoch: int, out: str) -> None:
    """One micro-batch of distinct requests."""
    rows = batch.withColumn("day", F.to_date("ts"))
    rows.persist()
    first, last = rows.agg(F.min("day"), F.max("day")).first()
    seen = counts.total(epoch, F.col("day").between(F.lit(first), F.lit(last))).withColumnRenamed("n", "__seen")
    nth = top_n_per_key(rows.select("request_id", "user_id", "day", "ts"), ["user_id", "day"], [F.col("ts"), F.col("request_id")],
                        MAX_QUOTA, out="__nth").select("request_id", "__nth")
    limit = daily_quota(F.coalesce("tier", F.lit("bronze")))
    place = F.coalesce("__seen", F.lit(0)) + F.coalesce("__nth", F.lit(MAX_QUOTA + 1))
    decided = (rows.join(seen, ["day", "user_id"], "left").join(tiers.select("user_id", "tier"), "user_id", "left")
               .join(nth, "request_id", "left").withColumn("passes", F.col("paid") | limit.isNull() | (place <= limit)))
    decided.select(*OUT).write.mode("overwrite").parquet(os.path.join(out, f"epoch={epoch}"))
    counts.write(epoch, rows.groupBy("day", "user_id").agg(F.count(F.lit(1)).alias("n")))
    rows.unpersist()


def run_quota(spark: SparkSession, requests: DataFrame, tiers: DataFrame, base: str, checkpoint: str,
              delay: str = "1 day") -> DataFrame:
    """requests: streaming (request_id, user_id, ts TIMESTAMP, paid); tiers:
    static (user_id, tier).  ``delay``: how late a request may come and still
    be counted.  Returns the decisions so far."""
    out = os.path.join(base, "decided")
    counts = Increments(spark, os.path.join(base, "counts"), DAY, "n")
    distinct = requests.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["request_id"])
    q = (distinct.writeStream.foreachBatch(lambda batch, epoch: decide(batch, tiers, counts, epoch, out))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out).drop("epoch")
