"""Plan-shape regression tests: the properties the design relies on."""

import re

from data_sets import SF_SMALL


def _plan(df, final=True):
    if final:
        df.collect()          # the same query execution, so the adaptive plan is the final one
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not final or "isFinalPlan=false" not in plan
    return plan


def test_hourly_scan_prunes_columns_and_pushes_range(spark):
    from demandlake.plans import daily
    plan = _plan(daily.hourly(spark, SF_SMALL), final=False)
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts,2024-01-01T00:00), LessThan(ts,2024-02-01T00:00)" in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string>" in plan


def test_feature_windows_share_one_exchange(spark):
    from demandlake.plans import daily
    plan = _plan(daily.feature_table(spark, SF_SMALL), final=False)
    by_zone = re.findall(r"Exchange hashpartitioning\(location_id#\d+, \d+\)", plan)
    assert len(by_zone) == 1                       # lags, rolling stats and time index together


def test_no_cartesian_or_nested_loop_joins_in_serving(spark):
    import __spark_entry__ as ent
    for name in ("serving_windows", "serving_status", "request_lifecycle", "daily_quota"):
        plan = _plan(ent.queries()[name](spark, SF_SMALL))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_no_single_partition_exchange_on_fact_tables(spark):
    import __spark_entry__ as ent
    for name in ("hourly_demand", "hourly_features", "unified_trips", "ledger_balances", "daily_quota"):
        plan = _plan(ent.queries()[name](spark, SF_SMALL))
        assert "Exchange SinglePartition" not in plan, name


def test_serving_builds_one_matrix_a_zone_hour(spark):
    from demandlake.plans import requests
    plan = _plan(requests.scaled_windows(spark, SF_SMALL))
    exploded = plan.index("posexplode")
    assert "Exchange" not in plan[:exploded]       # nothing is shuffled after the 72 positions are laid out


def test_backward_fill_is_linear(spark):
    from demandlake.plans import daily
    plan = _plan(daily.feature_table(spark, SF_SMALL, lag_fill="bfill"), final=False)
    assert "unboundedfollowing" not in plan.lower().replace(" ", "").split("count(1)")[0] or "first(" in plan
    assert "currentrow$(),unboundedfollowing$()" not in plan.replace(" ", "")
