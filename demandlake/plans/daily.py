"""The daily batch job as one lazy plan (fetch -> clean -> aggregate ->
features -> weather -> sort), bound to the driver tables.

Stage borders are materialised only where a later job re-reads the data
(``materialise``); inside one job Catalyst sees the whole plan.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlake import catalog
from demandlake.catalog import FeedSpec
from demandlake.operators import features as feat
from demandlake.operators.hourly import hourly_demand
from demandlake.session import stage_path
from demandlake.sources import feeds, weather


def events_spec(sf_dir: str) -> FeedSpec:
    return FeedSpec("events", os.path.join(sf_dir, "events.parquet"),
                    catalog.EVENTS_FEED_RENAME, "events")


def clean_trips(spark: SparkSession, sf_dir: str, start: str = catalog.EVENTS_START,
                end: str = catalog.EVENTS_END) -> DataFrame:
    """events -> (location_id, date, hour): B1, B2, B5, B11."""
    return feeds.unify_trips(spark, [events_spec(sf_dir)], start, end)


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly_demand(clean_trips(spark, sf_dir))


def weather_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weather.driver_weather(catalog.load(spark, sf_dir, "events"))


def feature_table(spark: SparkSession, sf_dir: str, adjacency: str = "calendar",
                  names: str = "all_nine", lag_fill: str = "zero") -> DataFrame:
    return feat.build_features(hourly(spark, sf_dir), weather_table(spark, sf_dir),
                               adjacency=adjacency, names=names, lag_fill=lag_fill)


_STAGED: dict[tuple, tuple[str, str]] = {}


def input_version(spark: SparkSession, path: str) -> tuple:
    """What the files under ``path`` are now: their number and a hash of their
    names, lengths and times.  One aggregate over the listing, no file is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return tuple(files.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first())


def stable_features(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    """The feature table written into the shared folder
    (``spark.checkpoint.dir``), for jobs that read it several times (scaler
    fit, windows, serving).  Its size is zones x hours of the span,
    independent of the trip volume; the stage also cuts the lineage, so a
    lost executor does not recompute the scan, dedup and windows, and later
    reads take only the columns they need.

    The rows are bucketed by zone and sorted by time in each bucket, so
    windows per zone need no exchange.  A session writes the stage once for an
    input version: jobs that follow read it, until files of the input change."""
    sc = spark.sparkContext
    events = events_spec(sf_dir).path
    key = (sc.applicationId, events, tuple(sorted(kw.items())))
    version = input_version(spark, events)
    name, seen = _STAGED.get(key, (None, None))
    if name is None or seen != version or not spark.catalog.tableExists(name):
        stage = f"features_{uuid.uuid4().hex[:12]}"
        bucketed(feature_table(spark, sf_dir, **kw), stage, stage_path(spark, stage), ("location_id",), ("time_idx",))
        if name is not None:
            # forgets the name only: jobs that read the older version keep its files
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        _STAGED[key] = (stage, version)
        name = stage
    return spark.table(name)


def bucketed(df: DataFrame, name: str, path: str, keys: tuple[str, ...], order: tuple[str, ...]) -> None:
    """Write table ``name`` at ``path``: as many buckets of ``keys`` as the
    cluster runs tasks at once, one file each."""
    n = max(2, df.sparkSession.sparkContext.defaultParallelism)
    (df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys, *order).format("parquet")
     .option("path", path).saveAsTable(name))


def materialise(df: DataFrame, path: str, partition_by: str | None = "date") -> DataFrame:
    """Write a stage as parquet (partitioned by date for pruning, each date
    gathered first so that it is one file) and read it back: the lineage is
    cut and a lost executor recomputes nothing upstream."""
    if partition_by:
        df.repartition(partition_by).write.mode("overwrite").partitionBy(partition_by).parquet(path)
        return df.sparkSession.read.parquet(path)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

