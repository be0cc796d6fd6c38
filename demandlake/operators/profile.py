"""Dataset profiling and exploratory aggregates.

Each profile is one pass of partial aggregates; top-k reports use
``orderBy(...).limit(k)``, which Spark plans as ``TakeOrderedAndProject``
(a per-task top-k, then a merge of k rows per task), never a global sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def column_profile(df: DataFrame) -> DataFrame:
    """Per column: type, null count and null percentage (2 places); plus
    the row and column counts of the frame (C3).  One aggregate pass."""
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("_rows")]
    aggs += [F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(cols)]
    wide = df.agg(*aggs)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    stacked = F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"),
                 F.lit(types[c]).alias("dtype"), F.col(f"n{i}").alias("null_count"))
        for i, c in enumerate(cols)]))
    return (wide.select("_rows", stacked)
            .select("position", "column_name", "dtype", "null_count",
                    F.col("_rows").alias("n_rows"), F.lit(len(cols)).alias("n_columns"),
                    F.round(F.col("null_count") * 100.0 / F.col("_rows"), 2).alias("null_pct")))


def null_ratio(df: DataFrame, col: str) -> DataFrame:
    """Share of nulls in one column (C4)."""
    return df.agg(F.avg(F.col(col).isNull().cast("double")).alias("null_ratio"))


def value_counts(df: DataFrame, col: str, n: int = 10) -> DataFrame:
    """Top-n values by frequency, ties by value."""
    return (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc(col)).limit(n))


def n_unique(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """Distinct non-null values per column (C5 ``nunique``); ``approx`` uses
    HyperLogLog++ so the state per task is a few KB whatever the volume."""
    fn = (lambda c: F.approx_count_distinct(c)) if approx else (lambda c: F.countDistinct(c))
    return df.agg(*[fn(F.col(c)).alias(f"nunique_{c}") for c in cols])


def busiest_hours(df: DataFrame, ts: str, n: int = 10) -> DataFrame:
    """Hours of day with most rows, top n."""
    return (df.groupBy(F.hour(F.col(ts)).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc("hour")).limit(n))


def total_by(df: DataFrame, key, value: str = "trips_count", name: str = "total") -> DataFrame:
    """Sum of a measure by a key (C7 hour of day, C10 weekday)."""
    return df.groupBy(key).agg(F.sum(value).alias(name))


def holiday_vs_regular(df: DataFrame, value: str = "trips_count",
                       flag: str = "is_holiday") -> DataFrame:
    """Mean *daily* total on holidays vs other days (C8): sum per
    (date, flag), then mean per flag.  The inner table has one row per day."""
    daily = df.groupBy("date", flag).agg(F.sum(value).alias("daily_total"))
    return daily.groupBy(flag).agg(F.avg("daily_total").alias("mean_daily_total"),
                                   F.count(F.lit(1)).alias("n_days"))


def top_by_total(df: DataFrame, key: str, value: str = "trips_count", n: int = 10) -> DataFrame:
    """Top-n keys by summed measure."""
    return (df.groupBy(key).agg(F.sum(value).alias("total"))
            .orderBy(F.desc("total"), F.asc(key)).limit(n))


def zone_means(df: DataFrame, features: Sequence[str], zone: str = "location_id") -> DataFrame:
    """NaN-ignoring mean of every feature per zone (C11): NaN -> null, then
    ``avg`` (which skips nulls); an all-missing feature stays null."""
    return df.groupBy(zone).agg(*[
        F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))).alias(c)
        for c in features])


def duplicate_count(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows, distinct rows and duplicates."""
    cols = list(cols) if cols else df.columns
    groups = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_c"))  # null groups kept, as pandas
    return (groups.agg(F.sum("_c").alias("n_rows"), F.count(F.lit(1)).alias("distinct_rows"))
            .withColumn("duplicates", F.col("n_rows") - F.col("distinct_rows")))


def out_of_range(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """Rows outside [start, end] (B6), with the extreme timestamps."""
    t = F.col(ts)
    bad = (t < F.to_timestamp_ntz(F.lit(start))) | (t > F.to_timestamp_ntz(F.lit(end)))
    return df.agg(F.count_if(bad).alias("n_out_of_range"),
                  F.count(F.lit(1)).alias("n_rows"),
                  F.min(t).alias("min_ts"), F.max(t).alias("max_ts"))


def row_count(df: DataFrame) -> DataFrame:
    """Row count and existence."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("non_empty", F.col("n_rows") > 0)
