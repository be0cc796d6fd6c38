import datetime as dt
import os
import tempfile

from demandlake.catalog import FeedSpec
from demandlake.operators.hourly import hourly_cost
from demandlake.sources import feeds, whitelist


def test_cost_filters_whitelist_cap_and_dedup(spark):
    d = tempfile.mkdtemp(prefix="dl-cost-", dir="/tmp")
    t = dt.datetime(2024, 1, 2, 8, 15)
    rows = [(t, 1, 2.0, 10.0),      # kept: 5 per mile
            (t, 1, 2.0, 10.0),      # exact duplicate -> collapses
            (t, 1, 0.0, 10.0),      # zero distance -> dropped (no infinity)
            (t, 1, 2.0, 0.0),       # zero cost -> dropped
            (t, 1, 0.01, 5.0),      # 500 per mile -> over the cap
            (t, 103, 2.0, 10.0),    # zone outside the whitelist
            (t, 7, 4.0, 10.0),      # kept: 2.5 per mile
            (dt.datetime(2023, 12, 31, 23, 0), 7, 1.0, 1.0)]   # before the range
    spark.createDataFrame(rows, "tpep_pickup_datetime timestamp_ntz, PULocationID long, "
                                "trip_distance double, fare_amount double").write.parquet(os.path.join(d, "yellow"))
    spec = FeedSpec("yellow", os.path.join(d, "yellow"),
                    {"tpep_pickup_datetime": "pickup_ts", "PULocationID": "location_id",
                     "trip_distance": "distance", "fare_amount": "cost"}, "yellow")
    trips = feeds.unify_costs(spark, [spec], "2024-01-01", "2024-04-01", zones=whitelist.zone_whitelist(spark))
    got = {r["location_id"]: (r["avg_cost_per_mile"], r["trips_count"]) for r in hourly_cost(trips).collect()}
    assert got == {1: (5.0, 1), 7: (2.5, 1)}
    assert whitelist.zone_whitelist(spark).count() == 238


def test_unify_trips_dedup_modes(spark):
    d = tempfile.mkdtemp(prefix="dl-unify-", dir="/tmp")
    t = dt.datetime(2024, 1, 2, 8, 15)
    spark.createDataFrame([(t, 5), (t, 5), (t, 6)], "tpep_pickup_datetime timestamp_ntz, PULocationID long") \
        .write.parquet(os.path.join(d, "yellow"))
    spark.createDataFrame([(t, 5), (dt.datetime(2025, 6, 1), 5)], "lpep_pickup_datetime timestamp_ntz, PULocationID long") \
        .write.parquet(os.path.join(d, "green"))
    specs = [FeedSpec("yellow", os.path.join(d, "yellow"), {"tpep_pickup_datetime": "pickup_ts", "PULocationID": "location_id"}),
             FeedSpec("green", os.path.join(d, "green"), {"lpep_pickup_datetime": "pickup_ts", "PULocationID": "location_id"})]
    per_feed = feeds.unify_trips(spark, specs, "2024-01-01", "2025-05-01")
    glob = feeds.unify_trips(spark, specs, "2024-01-01", "2025-05-01", dedup="global")
    assert per_feed.count() == 3          # (t, 5) once per feed, (t, 6); 2025-06 outside the range
    assert glob.count() == 2
    assert {tuple(r) for r in glob.collect()} == {("5", dt.date(2024, 1, 2), 8), ("6", dt.date(2024, 1, 2), 8)}
