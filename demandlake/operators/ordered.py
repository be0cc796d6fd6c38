"""Order-dependent helpers that stay parallel when one key is hot.

A window ``partitionBy(key).orderBy(t)`` sends every row of a key to one
task.  When one key may hold a third of all rows, prefix sums and ranks are
computed in two levels instead: inside (key, block) - where ``block`` is a
coarse monotone function of the order (e.g. the day or hour of the
timestamp) - and over the per-(key, block) totals, a table with one row per
block; the two are joined back on (key, block).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandlake.session import stage_path


def blocked_running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str,
                        block: Column, out: str = "running") -> DataFrame:
    """Cumulative sum of ``value`` per key in ``order`` (rows frame, current
    row included).  ``block`` must be non-decreasing along ``order``."""
    keys = list(keys)
    d = df.withColumn("_blk", block)
    inner = Window.partitionBy(*keys, "_blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_local", F.sum(value).over(inner))
    totals = d.groupBy(*keys, "_blk").agg(F.sum(value).alias("_tot"))
    prev = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_off", F.coalesce(F.sum("_tot").over(prev), F.lit(0))).drop("_tot")
    return (d.join(offsets, [*keys, "_blk"], "inner")
            .withColumn(out, F.col("_off") + F.col("_local"))
            .drop("_blk", "_local", "_off"))


def top_n_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                  out: str = "rank") -> DataFrame:
    """First n rows per key.  ``row_number() <= n`` with a literal n lets
    Spark insert a partial per-task group limit before the shuffle, so a hot
    key ships at most n rows per task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= n)


def dense_ordinal(df: DataFrame, col: str, out: str = "ordinal", partitions: int | None = None) -> DataFrame:
    """1-based dense rank of distinct values of ``col`` over the whole table
    without a single-task window: range partitioning (sampled boundaries),
    a per-partition count table (one row per partition) turned into offsets,
    and a local rank inside each range."""
    values = df.select(col).distinct()
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = values.repartitionByRange(n, col).withColumn("_pid", F.spark_partition_id())
    # written to the shared folder before it is read twice: the sampled range
    # boundaries are the same for the ranks and the counts, whatever the plan
    path = stage_path(df.sparkSession, f"ranges-{uuid.uuid4().hex[:12]}")
    ranged.write.parquet(path)
    ranged = df.sparkSession.read.schema(ranged.schema).parquet(path)
    local = ranged.withColumn("_local", F.row_number().over(Window.partitionBy("_pid").orderBy(col)))
    counts = local.groupBy("_pid").agg(F.max("_local").alias("_n"))
    prev = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(prev), F.lit(0))).drop("_n")
    return (local.join(F.broadcast(offsets), "_pid")
            .select(col, (F.col("_off") + F.col("_local")).cast("bigint").alias(out)))
