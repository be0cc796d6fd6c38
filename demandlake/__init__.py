"""demandlake: hourly demand analytics on Spark DataFrames.

Every operator is a function ``DataFrame -> DataFrame`` that takes its column
names as parameters, so the same code runs on real trip feeds and on the
driver's test tables.  Sub-packages:

* ``sources``   - feed readers, weather, account tables, sinks
* ``functions`` - column expressions (calendar, holidays, rounding, text)
* ``operators`` - cleaning, aggregation, features, windows, scaling,
                  forecasting, metrics, serving, ledger
* ``plans``     - composed jobs and the registered query catalogue
* ``streaming`` - Structured Streaming versions of the hourly counts,
                  request scoring, quota state and daily publish
"""

from demandlake.session import checkpoint_dir, get_session

__all__ = ["get_session", "checkpoint_dir"]
