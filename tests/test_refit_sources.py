import os
import tempfile

import pytest
from pyspark.sql import functions as F

from data_sets import SF_SMALL


def test_refit_writes_version_and_merges_scaler(spark):
    from demandlake.plans import daily, refit
    f = daily.stable_features(spark, SF_SMALL)
    base = tempfile.mkdtemp(prefix="dl-models-", dir="/tmp")
    first = refit.refit(spark, f, base)
    params, coef, icpt = refit.load(spark, first)
    assert coef.shape == (24 * 72, 24) and icpt.shape == (24,)
    second = refit.refit(spark, f, base, previous=params)
    p1 = {r["feature"]: r for r in params.collect()}
    p2 = {r["feature"]: r for r in refit.load(spark, second)[0].collect()}
    assert p2["y"]["n"] == 2 * p1["y"]["n"]                       # partial fit adds counts
    assert p2["y"]["mean"] == pytest.approx(p1["y"]["mean"])      # same data twice: same mean


def test_read_directory_skips_hidden_and_classifies(spark):
    from demandlake.sources import feeds
    d = tempfile.mkdtemp(prefix="dl-feeds-", dir="/tmp")
    spark.range(3).write.parquet(os.path.join(d, "yellow_2024"))
    spark.range(2).write.parquet(os.path.join(d, "green_2024"))
    spark.range(5).write.parquet(os.path.join(d, ".hidden"))
    df = feeds.read_directory(spark, d).select(
        feeds.classify_feed(F.col("_metadata.file_path"), [("yellow", "yellow"), ("green", "green")]).alias("k"))
    got = {r["k"]: r["count"] for r in df.groupBy("k").count().collect()}
    assert got == {"yellow": 3, "green": 2}


def test_feed_gate_skips_feed_without_zone(spark):
    from demandlake.catalog import FeedSpec
    from demandlake.sources import feeds
    d = tempfile.mkdtemp(prefix="dl-fhv-", dir="/tmp")
    spark.createDataFrame([("2024-01-01 10:00:00", 5)], "pickup_datetime string, PUlocationID int") \
        .write.parquet(os.path.join(d, "fhv"))
    spec = FeedSpec("fhv", os.path.join(d, "fhv"), {"pickup_datetime": "pickup_ts", "PULocationID": "location_id"})
    assert feeds.read_feed(spark, spec) is None
    ok = FeedSpec("fhv", os.path.join(d, "fhv"), {"pickup_datetime": "pickup_ts", "PUlocationID": "location_id"})
    rows = feeds.read_feed(spark, ok).collect()
    assert rows[0]["pickup_ts"].hour == 10                      # string coerced to a timestamp


def test_unparseable_timestamp_becomes_null(spark):
    from demandlake.sources import feeds
    from pyspark.sql import types as T
    df = spark.createDataFrame([("2024-01-01 10:00:00",), ("not a time",)], "t string")
    out = df.select(feeds.coerce_timestamp(F.col("t"), T.StringType()).alias("t")).collect()
    assert out[0]["t"] is not None and out[1]["t"] is None


def test_feature_cache_switches_path(spark):
    from demandlake.sources.sinks import FeatureCache
    d = tempfile.mkdtemp(prefix="dl-cache-", dir="/tmp")
    spark.range(2).write.parquet(os.path.join(d, "a"))
    spark.range(4).write.parquet(os.path.join(d, "b"))
    c = FeatureCache(spark)
    assert c.get(os.path.join(d, "a")).count() == 2
    assert c.get(os.path.join(d, "b")).count() == 4 and c.path.endswith("b")
