"""The feature stage: written once for an input version, bucketed by zone."""

import os
import shutil

import pyarrow.parquet as pq
from pyspark.sql import Window
from pyspark.sql import functions as F

from data_sets import SF_SMALL
from demandlake.plans import daily


def _final_plan(df):
    run = df._jdf.queryExecution()
    df.collect()
    return run.executedPlan().toString()


def test_staged_once_until_the_input_changes(spark, tmp_path):
    events = os.path.join(tmp_path, "events.parquet")
    shutil.copy(os.path.join(SF_SMALL, "events.parquet"), events)
    first = daily.stable_features(spark, str(tmp_path))
    again = daily.stable_features(spark, str(tmp_path))
    assert sorted(first.inputFiles()) == sorted(again.inputFiles())
    want = {tuple(r) for r in daily.feature_table(spark, str(tmp_path)).select("location_id", "date", "hour", "trips_count").collect()}
    assert {tuple(r) for r in first.select("location_id", "date", "hour", "trips_count").collect()} == want
    assert not set(daily.stable_features(spark, str(tmp_path), names="batch_exact").inputFiles()) & set(first.inputFiles())

    table = pq.read_table(events)
    pq.write_table(table.slice(0, table.num_rows // 2), events)
    changed = daily.stable_features(spark, str(tmp_path))
    assert not set(changed.inputFiles()) & set(first.inputFiles())
    assert changed.agg(F.sum("trips_count")).first()[0] < sum(r[3] for r in want)
    assert first.count() == len(want)                          # the older version stays readable


def test_windows_per_zone_need_no_exchange(spark):
    staged = daily.stable_features(spark, SF_SMALL)
    w = Window.partitionBy("location_id").orderBy("time_idx")
    plan = _final_plan(staged.select("location_id", F.lag("trips_count").over(w).alias("before")))
    assert "Exchange" not in plan and "Bucketed: true" in plan
