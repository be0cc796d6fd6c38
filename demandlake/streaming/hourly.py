"""Streaming hourly demand (L1) and the daily incremental publish (L4).

``withWatermark`` needs a TIMESTAMP column, so the naive pickup time is
cast with the session time zone pinned to UTC.  Exact duplicates (same
zone, same instant) are removed within the watermark, which bounds the
state; a row that arrives later than the watermark is dropped.

L1 adds up as it goes: each micro-batch of new distinct trips is counted
per zone and hour and written as the epoch's increment (``increments``); the
table is their sum per key.  Every hour is there at once, the last ones too,
and a replayed epoch overwrites its own increment.  The publish reads the same
sums, so trips of an hour that come in several batches add up.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandlake.sources import sinks
from demandlake.streaming.increments import Increments

KEYS = ("location_id", "date", "hour")


def trip_stream(spark: SparkSession, directory: str, file_glob: str, schema: T.StructType,
                ts: str, zone: str) -> DataFrame:
    """Raw feed files arriving in ``directory`` -> (pickup, location_id)."""
    raw = (spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
           .option("maxFilesPerTrigger", 1).parquet(directory))
    return raw.select(F.col(ts).cast("timestamp").alias("pickup"), F.col(zone).alias("location_id"))


def distinct_trips(trips: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Clean trips of a stream, exact duplicates removed within the watermark."""
    return (trips.where(F.col("pickup").isNotNull() & F.col("location_id").isNotNull())
            .withWatermark("pickup", delay).dropDuplicatesWithinWatermark(["pickup", "location_id"]))


HOUR = T.StructType([T.StructField("date", T.DateType()), T.StructField("hour", T.IntegerType()),
                     T.StructField("location_id", T.StringType())])


def trip_counts(spark: SparkSession, path: str, zone: T.DataType | None = None) -> Increments:
    """Trips per (date, hour, zone) by epoch under ``path``."""
    keys = T.StructType([*HOUR.fields[:2], T.StructField("location_id", zone or T.StringType())])
    return Increments(spark, path, keys, "trips_count")


def _per_hour(batch: DataFrame) -> DataFrame:
    return batch.groupBy(F.to_date("pickup").alias("date"), F.hour("pickup").alias("hour"), "location_id").agg(
        F.count(F.lit(1)).alias("trips_count"))


def run_hourly(spark: SparkSession, trips: DataFrame, out: str, checkpoint: str,
               delay: str = "1 hour") -> None:
    """Count trips per zone and hour (L1) into the increments under ``out``."""
    counts = trip_counts(spark, out, trips.schema["location_id"].dataType)
    q = (distinct_trips(trips, delay).writeStream
         .foreachBatch(lambda batch, epoch: counts.write(epoch, _per_hour(batch)))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def hourly_table(spark: SparkSession, out: str, zone: T.DataType | None = None) -> DataFrame:
    """(date, hour, location_id, trips_count): the increments added up."""
    return trip_counts(spark, out, zone).total()


# --- L4 -----------------------------------------------------------------------

MANIFEST = T.StructType([T.StructField("version", T.LongType()), T.StructField("date", T.DateType()),
                         T.StructField("folder", T.StringType())])


def _manifest(spark: SparkSession, published: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(os.path.join(published, "manifest"))


def publish_dates(df: DataFrame, published: str, version: int) -> None:
    """Write the dates of ``df`` into a new folder, then commit them: the
    manifest gets a row (version, date, folder) for each date in one file,
    and only that makes the folder visible.  A failure before the commit
    leaves an unused folder; a repeat writes another one."""
    spark = df.sparkSession
    folder = uuid.uuid4().hex[:16]
    path = os.path.join(published, "data", f"folder={folder}")
    df.repartition("date").sortWithinPartitions(*KEYS).write.partitionBy("date").parquet(path)
    rows = df.select("date").distinct().select(F.lit(version).cast("long").alias("version"), "date", F.lit(folder).alias("folder"))
    rows.coalesce(1).write.mode("append").parquet(os.path.join(published, "manifest"))


def live(spark: SparkSession, published: str, before: int | None = None, dates: Sequence | None = None) -> DataFrame | None:
    """The published rows: of every date the folder with the highest version
    (on ties the greater folder name, an equal repeat).  ``before``: only
    versions below it; ``dates``: only those.  The manifest has a row per
    date and version.  None when nothing is published."""
    m = _manifest(spark, published)
    if before is not None:
        m = m.where(F.col("version") < before)
    if dates is not None:
        m = m.where(F.col("date").isin(list(dates)))
    top = m.groupBy("date").agg(F.max(F.struct("version", "folder")).alias("top")).collect()
    if not top:
        return None
    base = os.path.join(published, "data")
    paths = [os.path.join(base, f"folder={r['top']['folder']}", f"date={r['date']}") for r in top]
    return spark.read.option("basePath", base).parquet(*paths).drop("folder")


def publish_epoch(batch: DataFrame, published: str, epoch: int, keys: Sequence[str] = KEYS,
                  version_col: str = "version") -> None:
    """One micro-batch of distinct trips -> hours, upserted into the dates it
    touches.  An hour that the stream has reached counts all trips the stream
    has brought for it, in this epoch and earlier ones.  Version 1 is the
    initial dataset, epoch N writes version N + 2 on top of the versions below
    it, so a replayed epoch starts from the same state.  The driver holds one
    row per date that the batch touches."""
    spark = batch.sparkSession
    counts = trip_counts(spark, os.path.join(published, "counts"), batch.schema["location_id"].dataType)
    counts.write(epoch, _per_hour(batch.where(F.col("pickup").isNotNull() & F.col("location_id").isNotNull())))
    added = spark.read.schema(counts.schema).parquet(f"{counts.path}/epoch={epoch}")
    dates = [r["date"] for r in added.select("date").distinct().collect()]
    if not dates:
        return
    total = counts.total(epoch + 1, F.col("date").isin(dates))
    hit = added.select(*keys).distinct()
    new = total.join(hit, list(keys), "left_semi").withColumn(version_col, F.lit(epoch + 2))
    old = live(spark, published, before=epoch + 2, dates=dates)
    if old is not None:
        new = sinks.publish_upsert(old.select(*new.columns), new, keys)
    publish_dates(new, published, epoch + 2)
    expire(spark, published, epoch + 1)


def expire(spark: SparkSession, published: str, version: int) -> None:
    """Delete the data folders that neither ``version`` nor a later one
    shows.  Readers of the version just replaced keep their files."""
    shown = _manifest(spark, published)
    past = shown.where(F.col("version") <= version).groupBy("date").agg(F.max(F.struct("version", "folder"))["folder"].alias("folder"))
    needed = past.select("folder").union(shown.where(F.col("version") > version).select("folder"))
    jvm = spark.sparkContext._jvm
    for r in shown.select("folder").distinct().join(needed.distinct(), "folder", "left_anti").collect():
        path = jvm.org.apache.hadoop.fs.Path(os.path.join(published, "data", f"folder={r['folder']}"))
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run_incremental_publish(spark: SparkSession, trips: DataFrame, published: str, checkpoint: str,
                            delay: str = "1 hour") -> DataFrame:
    """Daily incremental publish (L4): each micro-batch rewrites the dates it
    touches and nothing else; readers see it when its commit is there.  Trips
    that repeat within the watermark, in whatever batch, count once."""
    q = (distinct_trips(trips, delay).writeStream.foreachBatch(lambda batch, epoch: publish_epoch(batch, published, epoch))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return live(spark, published)
