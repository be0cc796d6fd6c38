"""Hourly aggregation.

A partial hash aggregate runs map-side, so each task ships at most one row
per (date, hour, zone) into the shuffle whatever the trip volume; a hot zone
is spread over its hours.  There is no zero fill: an hour without trips has
no row, as in the batch job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("date", "hour", "location_id")


def hourly_demand(trips: DataFrame, keys=KEYS) -> DataFrame:
    """``trips_count`` per (date, hour, location_id)."""
    return trips.groupBy(*keys).agg(F.count(F.lit(1)).alias("trips_count"))


def hourly_cost(trips: DataFrame, keys=KEYS, cost_col: str = "cost_per_mile") -> DataFrame:
    """Mean cost per mile and trip count per key."""
    return trips.groupBy(*keys).agg(
        F.avg(cost_col).alias("avg_cost_per_mile"),
        F.count(F.lit(1)).alias("trips_count"))
