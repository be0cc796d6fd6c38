"""Trip feed readers and unification.

Each feed is read with its own reader so that the time-range filter is
expressed on the raw timestamp column and reaches the parquet scan as a
pushed filter; only the needed columns are read (``ReadSchema``).
"""

from __future__ import annotations

import functools
import logging
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandlake.catalog import COST, DISTANCE, PICKUP, ZONE, FeedSpec

log = logging.getLogger(__name__)


def _ts_literal(value: str, dtype: T.DataType) -> Column:
    """A timestamp literal of the same type as the column it is compared to,
    so no cast lands on the column and the predicate stays pushable."""
    if isinstance(dtype, T.TimestampNTZType):
        return F.to_timestamp_ntz(F.lit(value))
    if isinstance(dtype, T.DateType):
        return F.to_date(F.lit(value))
    return F.to_timestamp(F.lit(value))


def coerce_timestamp(c: Column, dtype: T.DataType) -> Column:
    """Unparseable -> null (A5).  Typed columns pass through untouched."""
    if isinstance(dtype, (T.TimestampNTZType, T.TimestampType)):
        return c
    if isinstance(dtype, T.DateType):
        return c.cast("timestamp_ntz")
    return F.try_to_timestamp(c.cast("string")).cast("timestamp_ntz")


def classify_feed(file_name: Column, patterns: Sequence[tuple[str, str]]) -> Column:
    """Feed kind from a file name: substrings tested in order on the
    lower-cased name, first match wins (A2).  Unmatched -> null."""
    name = F.lower(file_name)
    out = None
    for pattern, kind in patterns:
        cond = name.contains(pattern)
        out = F.when(cond, F.lit(kind)) if out is None else out.when(cond, F.lit(kind))
    return out


def read_raw(spark: SparkSession, spec: FeedSpec) -> DataFrame:
    """One feed, columns renamed to the unified names (A1, A3)."""
    df = spark.read.parquet(spec.path)
    return df.withColumnsRenamed({k: v for k, v in spec.rename.items() if k in df.columns})


def read_feed(spark: SparkSession, spec: FeedSpec, required: Sequence[str] = (PICKUP, ZONE),
              start: str | None = None, end: str | None = None) -> DataFrame | None:
    """Renamed, projected, range-filtered and typed feed, or None when the
    feed lacks a required column after renaming (A4: skipped and logged)."""
    df = read_raw(spark, spec)
    missing = [c for c in required if c not in df.columns]
    if missing:
        log.warning("feed %s skipped: missing %s", spec.name, missing)
        return None
    df = df.select(*required)
    dtype = df.schema[PICKUP].dataType
    if not isinstance(dtype, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        # text: coerce first, so an unparseable value is null instead of a
        # failed comparison; typed columns are filtered raw (pushed filter)
        df = df.withColumn(PICKUP, coerce_timestamp(F.col(PICKUP), dtype))
        dtype = T.TimestampNTZType()
    if start is not None:
        df = df.where(F.col(PICKUP) >= _ts_literal(start, dtype))
    if end is not None:
        df = df.where(F.col(PICKUP) < _ts_literal(end, dtype))
    return df.withColumn(PICKUP, coerce_timestamp(F.col(PICKUP), dtype))


def clean(df: DataFrame, subset: Sequence[str] | None = None, dedup: bool = True) -> DataFrame:
    """Drop rows with a null in the kept columns, then exact duplicates (B1, B2)."""
    cols = list(subset) if subset else df.columns
    out = df.na.drop(subset=cols)
    return out.dropDuplicates(cols) if dedup else out


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    """Union by column name; the positional index is gone by construction."""
    return functools.reduce(DataFrame.unionByName, list(frames))


def with_date_hour(df: DataFrame, ts: str = PICKUP, drop_ts: bool = True) -> DataFrame:
    """Derive ``date`` and ``hour`` and drop the timestamp."""
    out = df.withColumns({"date": F.to_date(F.col(ts)), "hour": F.hour(F.col(ts))})
    return out.drop(ts) if drop_ts else out


def unify_trips(spark: SparkSession, feeds: Sequence[FeedSpec], start: str, end: str,
                dedup: str = "per_feed", zone_type: str = "string") -> DataFrame:
    """Unified clean trips ``(location_id, date, hour)`` (load_and_clean).

    ``dedup='per_feed'`` removes duplicates inside each feed (batch job);
    ``'global'`` removes them once after the union (notebooks), which gives
    the same rows as per-feed plus cross-feed removal with one shuffle.
    """
    frames = []
    for spec in feeds:
        df = read_feed(spark, spec, (PICKUP, ZONE), start, end)
        if df is None:
            continue
        df = df.withColumn(ZONE, F.col(ZONE).cast(zone_type))
        frames.append(clean(df, dedup=(dedup == "per_feed")))
    trips = union_all(frames)
    if dedup == "global":
        trips = trips.dropDuplicates([PICKUP, ZONE])
    return with_date_hour(trips)


def cost_per_mile(df: DataFrame, cap: float | None = 100.0) -> DataFrame:
    """Positive distance and cost (B7), their ratio (B8) below the outlier
    cap (B9; None: no cap), inputs dropped (B12)."""
    out = df.where((F.col(DISTANCE) > 0) & (F.col(COST) > 0)).withColumn(
        "cost_per_mile", F.try_divide(F.col(COST), F.col(DISTANCE)))
    if cap is not None:
        out = out.where(F.col("cost_per_mile") < cap)
    return out.drop(COST, DISTANCE)


def unify_costs(spark: SparkSession, feeds: Sequence[FeedSpec], start: str, end: str,
                zones: DataFrame | None = None, cap: float | None = 100.0) -> DataFrame:
    """Unified trips with ``cost_per_mile`` (cost variant of load_raw_data).

    Positive distance and cost (B7), ratio with infinities as null (B8),
    outlier cap (B9; None: no cap), zone whitelist as a semi-join (B10/E6;
    None: all zones), then null drop and one dedup over the union, which
    also covers duplicates inside a feed.
    """
    frames = []
    for spec in feeds:
        df = read_feed(spark, spec, (PICKUP, ZONE, DISTANCE, COST), start, end)
        if df is None:
            continue
        if zones is not None:
            # the whitelist is bounded by its highest id
            df = df.join(F.broadcast(zones.select(F.col(ZONE).cast(df.schema[ZONE].dataType).alias(ZONE))),
                         ZONE, "left_semi")
        frames.append(clean(cost_per_mile(df, cap), dedup=False))
    trips = union_all(frames).dropDuplicates()
    return with_date_hour(trips)


def union_on_common_columns(frames: Sequence[DataFrame], rename: dict | None = None) -> DataFrame:
    """Harmonise names, keep the columns all frames share, union."""
    rename = rename or {}
    renamed = [f.withColumnsRenamed({k: v for k, v in rename.items() if k in f.columns}) for f in frames]
    common = [c for c in renamed[0].columns if all(c in f.columns for f in renamed[1:])]
    return union_all(f.select(*common) for f in renamed)


def read_csv_typed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV stage file with an explicit schema, dates parsed (A10)."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_directory(spark: SparkSession, path: str, glob: str = "*.parquet") -> DataFrame:
    """Multi-file scan of a directory tree (A1, A8).  Spark already skips
    files and folders starting with ``_`` or ``.``."""
    return (spark.read.option("recursiveFileLookup", True)
            .option("pathGlobFilter", glob).parquet(path))
