"""Table roles: which driver table plays which part of the demand domain.

There is no taxi data in the test set, so the operators run on the driver's
tables through this mapping.  Every operator takes column names as
parameters; the mapping below is the only place that knows them.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


@dataclass(frozen=True)
class FeedSpec:
    """One raw trip feed: where it lives and how its columns map to ours.

    ``rename`` maps raw column names to the unified names ``pickup_ts``,
    ``location_id`` (and ``distance``/``cost`` for the cost variant).
    ``name_pattern`` is the lower-case file-name substring that identifies
    the feed when several feeds share one directory.
    """

    name: str
    path: str
    rename: dict = field(default_factory=dict)
    name_pattern: str | None = None


# Unified column names.
PICKUP = "pickup_ts"
ZONE = "location_id"
DISTANCE = "distance"
COST = "cost"


def driver_feeds(sf_dir: str) -> list[FeedSpec]:
    """Three feeds with different raw schemas, as the taxi providers have.

    events   : ts / event_type            (the trip feed proper, Jan 2024)
    orders   : o_orderdate / o_orderpriority
    lineitem : l_shipdate / l_returnflag
    """
    return [
        FeedSpec("events", os.path.join(sf_dir, "events.parquet"),
                 {"ts": PICKUP, "event_type": ZONE}, "events"),
        FeedSpec("orders", os.path.join(sf_dir, "orders.parquet"),
                 {"o_orderdate": PICKUP, "o_orderpriority": ZONE}, "orders"),
        FeedSpec("lineitem", os.path.join(sf_dir, "lineitem.parquet"),
                 {"l_shipdate": PICKUP, "l_returnflag": ZONE}, "lineitem"),
    ]


def cost_feed(sf_dir: str) -> FeedSpec:
    """Cost variant: lineitem price per unit plays cost per mile."""
    return FeedSpec("lineitem", os.path.join(sf_dir, "lineitem.parquet"),
                    {"l_shipdate": PICKUP, "l_suppkey": ZONE,
                     "l_quantity": DISTANCE, "l_extendedprice": COST}, "lineitem")


def capped_cost_feed(sf_dir: str) -> FeedSpec:
    """Cost variant whose ratios lie on both sides of the outlier cap of 100:
    price over part key."""
    return FeedSpec("lineitem", os.path.join(sf_dir, "lineitem.parquet"),
                    {"l_shipdate": PICKUP, "l_suppkey": ZONE,
                     "l_partkey": DISTANCE, "l_extendedprice": COST}, "lineitem")


# The trip feed used by the hourly-demand queries: events, zone = event_type.
EVENTS_FEED_RENAME = {"ts": PICKUP, "event_type": ZONE}
# Half-open time range of the events feed (January 2024 holds all rows).
EVENTS_START = "2024-01-01"
EVENTS_END = "2024-02-01"

# Harmonised names for the wide union on shared columns.
WIDE_RENAME = {
    "ts": PICKUP, "o_orderdate": PICKUP, "l_shipdate": PICKUP,
    "event_type": ZONE, "o_orderpriority": ZONE, "l_returnflag": ZONE,
    "value": "amount", "o_totalprice": "amount", "l_extendedprice": "amount",
}
