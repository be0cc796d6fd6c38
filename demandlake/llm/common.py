"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlake.session import stage_path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: the
    lineage is cut, every executor sees the files, and a lost executor costs
    only the tasks it was running."""
    spark = df.sparkSession
    path = stage_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(staged: DataFrame) -> None:
    """Delete the files of a staged table that nothing will read again (what
    was computed from it has been staged itself)."""
    spark = staged.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {name.rpartition("/")[0] for name in staged.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def crc_remainder(col: str, divisor: int):
    """crc32 of the id written as text, modulo ``divisor``; a null id counts as
    an empty text (remainder 0)."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(divisor))
