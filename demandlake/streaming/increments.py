"""Additive counts that grow by one increment an epoch.

A stream that counts (trips per zone and hour, requests per user and day)
writes what an epoch adds into ``epoch=<id>``; a count is the sum over epochs.
Rewriting an epoch's folder makes a replay harmless.  Every ``FOLD`` epochs the
older ones are summed into one folder ``folded/upto=<id>``: the greatest
complete one is the watermark below which epoch folders no longer count.  A
fold at epoch N takes epochs below N only, which are committed and never
replayed, so a replay before, while and after a fold gives the same table.
Folders that a fold has replaced go at the fold after it, when readers that
listed them before have long finished.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOLD = 16


class Increments:
    def __init__(self, spark: SparkSession, path: str, keys: T.StructType, value: str, fold: int = FOLD):
        self.spark, self.path, self.value, self.every = spark, path.rstrip("/"), value, fold
        self.keys = [f.name for f in keys.fields]
        self.schema = T.StructType([*keys.fields, T.StructField(value, T.LongType())])

    def _folders(self, under: str, name: str) -> dict[int, str]:
        """Complete folders ``<name>=<number>`` by number."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(under)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = {}
        if fs.exists(path):
            for status in fs.listStatus(path):
                m = re.fullmatch(rf"{name}=(\d+)", status.getPath().getName())
                if m and fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                    found[int(m.group(1))] = f"{under}/{name}={m.group(1)}"
        return found

    def _delete(self, folder: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def _live(self, before: int | None) -> tuple[list[str], int]:
        """Folders that count for epochs below ``before`` (None: all), and the
        last epoch that is folded (-1: none)."""
        folded = {n: p for n, p in self._folders(f"{self.path}/folded", "upto").items() if before is None or n < before}
        upto = max(folded, default=-1)
        epochs = self._folders(self.path, "epoch")
        return ([folded[upto]] if folded else []) + [p for n, p in sorted(epochs.items()) if n > upto and (before is None or n < before)], upto

    def write(self, epoch: int, counts: DataFrame) -> None:
        """Set what ``epoch`` adds (sorted by key, so a filter on leading
        keys reads few row groups), folding older epochs when it is time."""
        counts.select(*self.schema.names).sortWithinPartitions(*self.keys).write.mode("overwrite").parquet(f"{self.path}/epoch={epoch}")
        if epoch and epoch % self.every == 0:
            self.fold(epoch)

    def fold(self, epoch: int) -> None:
        paths, upto = self._live(epoch)
        if len(paths) > 1:
            (self._sum(paths).sortWithinPartitions(*self.keys).write.mode("overwrite")
             .parquet(f"{self.path}/folded/upto={epoch - 1}"))
        for n, p in self._folders(f"{self.path}/folded", "upto").items():
            if n < upto:
                self._delete(p)
        for n, p in self._folders(self.path, "epoch").items():
            if n <= upto:
                self._delete(p)

    def _sum(self, paths: Sequence[str]) -> DataFrame:
        return (self.spark.read.schema(self.schema).parquet(*paths).groupBy(*self.keys)
                .agg(F.sum(self.value).alias(self.value)))

    def total(self, before: int | None = None, where=None) -> DataFrame:
        """The counts of all epochs below ``before``; ``where`` reaches the
        scan."""
        paths, _ = self._live(before)
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*paths)
        return (rows if where is None else rows.where(where)).groupBy(*self.keys).agg(F.sum(self.value).alias(self.value))
