"""One import surface for the operators; see the modules for parameters.  Everything takes and returns DataFrames, except the fitted
scaler / model helpers, which return small bounded parameter tables or
Spark ML models.
"""

from __future__ import annotations

from demandlake.functions.calendar import (  # noqa: F401
    dim_holiday, holiday_name, is_holiday, with_calendar, with_calendar_adjacency,
)
from demandlake.functions.text import (  # noqa: F401
    analogue_ts, format_forecast, list_to_text, next_hour, request_day, text_to_list,
)
from demandlake.operators.baselines import baseline_predictions  # noqa: F401
from demandlake.operators.features import (  # noqa: F401
    build_features, sorted_series, with_lags, with_rolling, with_row_adjacency, with_time_idx, with_time_lags, with_weather,
)
from demandlake.operators.hourly import hourly_cost, hourly_demand  # noqa: F401
from demandlake.operators.ledger import (  # noqa: F401
    affordability, daily_quota, expire_tiers, history, monthly_active, owner_lookup, owner_lookups, quota, register_users,
    replay_ledger, request_lifecycle, request_price, retention, running_balance, tier_price,
)
from demandlake.operators import lagged, lifecycle, trees  # noqa: F401
from demandlake.operators.metrics import (  # noqa: F401
    best, error_matrix_wide, evaluate, evaluate_pooled, mae_by, model_table,
)
from demandlake.operators.models import (  # noqa: F401
    cost_pipeline, fit_cost, fit_linear, predict_cost, predict_linear, price_forecast, regression_metrics,
    score_sequences, split_random,
)
from demandlake.operators.profile import (  # noqa: F401
    busiest_hours, column_profile, duplicate_count, holiday_vs_regular, n_unique, null_ratio, out_of_range,
    row_count, top_by_total, total_by, value_counts, zone_means,
)
from demandlake.operators.scaling import (  # noqa: F401
    fit_scaler, impute, long_form, merge_scaler, transform, window_weights,
)
from demandlake.operators.sequences import (  # noqa: F401
    day_block, input_arrays, targets_long, windows, zone_index, zone_stats,
)
from demandlake.operators.serving import (  # noqa: F401
    asof_grid, cost_features, forecast_hours, post_process, request_forecasts, resolve_requests, serving_arrays, serving_windows, window_matrices,
)
from demandlake.plans.refit import refit  # noqa: F401
from demandlake.sources.feeds import (  # noqa: F401
    classify_feed, clean, cost_per_mile, read_csv_typed, read_directory, read_feed, union_on_common_columns, unify_costs,
    unify_trips,
)
from demandlake.sources.sinks import (  # noqa: F401
    FeatureCache, publish_append, publish_sorted, publish_upsert, sample_head, write_stage,
)
from demandlake.sources.weather import hourly_weather, nearest_station, weather_at  # noqa: F401
from demandlake.streaming.hourly import hourly_table, live, publish_dates, run_hourly, run_incremental_publish  # noqa: F401
from demandlake.streaming.balances import ledger_stream, run_ledger  # noqa: F401
from demandlake.streaming.increments import Increments  # noqa: F401
from demandlake.streaming.quota import run_quota  # noqa: F401
from demandlake.streaming.requests import finished_requests, request_stream, run_request_scoring, score_batch  # noqa: F401
