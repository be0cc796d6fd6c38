"""Sinks: stage materialisation, dataset publish, samples, cache.

Writes go to the shared folder named by ``spark.checkpoint.dir`` (or a path
the caller gives); a publish writes a new versioned folder and readers
switch to it only after the write succeeded, so a lost executor or a failed
job never leaves a half-written dataset behind.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def sample_head(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """First n rows in key order (A14); planned as a per-task top-n."""
    return df.orderBy(*order).limit(n)


def publish_append(old: DataFrame, new: DataFrame) -> DataFrame:
    """Existing rows plus new rows, no dedup (A13, reference parity: re-running
    a day duplicates its rows)."""
    return old.unionByName(new)


def publish_upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows replace old rows with the same key (A13, idempotent).

    Old rows whose key appears in ``new`` are removed with an anti-join, then
    the new rows are appended: re-running a day leaves the dataset unchanged.
    """
    keep = old.join(new.select(*keys).distinct(), list(keys), "left_anti")
    return keep.unionByName(new)


def write_stage(df: DataFrame, path: str, partition_by: Sequence[str] = ("date",),
                fmt: str = "parquet") -> None:
    """Materialise a stage border (A9) partitioned for pruning."""
    if partition_by:
        # a partition value is gathered first: one file each, not one a task
        df.repartition(*partition_by).write.mode("overwrite").format(fmt).partitionBy(*partition_by).save(path)
    else:
        df.write.mode("overwrite").format(fmt).save(path)


class FeatureCache:
    """Cached feature table keyed by path; a new path drops the old cache."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path: str | None = None
        self.df: DataFrame | None = None

    def get(self, path: str) -> DataFrame:
        if self.df is None or path != self.path:
            if self.df is not None:
                self.df.unpersist()
            self.df = self.spark.read.parquet(path).cache()
            self.path = path
        return self.df


def publish_sorted(df: DataFrame, path: str, keys: Sequence[str] = ("location_id", "date", "hour")) -> None:
    """Publish re-sorted by zone and time (A13): range partitions of the key
    order, sorted inside, so files do not overlap and readers can skip them."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)
