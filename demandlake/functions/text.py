"""Text and time helpers of the request path.

All are column expressions; arrays are formatted with ``transform`` /
``array_join`` inside the generated code, no explode and no grouping.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The forecast line template.
LOCAL_SHIFT_HOURS = -8
LINE_PREFIX = "\U0001F552 "          # clock
LINE_DEMAND = ":00 - \U0001F697 "     # car
LINE_TRIPS = " поездок"
LINE_COST = ", \U0001F4B0 "          # money bag
LINE_COST_UNIT = " $ per mile"
ANALOGUE_YEAR = 2024


def list_to_text(arr: Column, integral: bool = True) -> Column:
    """Array -> ``[1, 2, 3]`` text as stored in the predictions table."""
    elem = (lambda x: x.cast("bigint").cast("string")) if integral else (lambda x: x.cast("string"))
    return F.concat(F.lit("["), F.array_join(F.transform(arr, elem), ", "), F.lit("]"))


def text_to_list(text: Column, element: T.DataType = T.DoubleType()) -> Column:
    """``[1, 2, 3]`` text -> array."""
    return F.from_json(text, T.ArrayType(element))


def hour_label(start: Column, i: Column, shift: int = LOCAL_SHIFT_HOURS) -> Column:
    """Local hour ``(start + i + shift) mod 24`` as two digits (F16)."""
    return F.lpad(F.pmod(start + i + F.lit(shift), F.lit(24)).cast("string"), 2, "0")


def format_forecast(hour_start: Column, demand: Column, costs: Column | None = None,
                    shift: int = LOCAL_SHIFT_HOURS) -> Column:
    """One line per forecast hour, joined by newlines (F16)."""
    def line(d, i):
        text = F.concat(F.lit(LINE_PREFIX), hour_label(hour_start, i, shift), F.lit(LINE_DEMAND),
                        d.cast("bigint").cast("string"), F.lit(LINE_TRIPS))
        if costs is not None:
            text = F.concat(text, F.lit(LINE_COST), F.format_string("%.2f", F.element_at(costs, i + 1)),
                            F.lit(LINE_COST_UNIT))
        return text
    return F.array_join(F.transform(demand, line), "\n")


def next_hour(hour: Column) -> Column:
    """The hour a new request asks for: (hour + 1) mod 24."""
    return F.pmod(hour + F.lit(1), F.lit(24))


def request_day(ts: Column) -> tuple[Column, Column, Column]:
    """(year, month, day) of the request time + 1 hour."""
    t = F.timestamp_add("HOUR", F.lit(1), ts)
    return F.year(t), F.month(t), F.dayofmonth(t)


def analogue_ts(month: Column, day: Column, hour: Column, year: int = ANALOGUE_YEAR) -> Column:
    """The target instant in the analogue year: month/day/hour kept.
    An impossible date (29 Feb outside a leap year) gives null."""
    return F.try_make_timestamp_ntz(F.lit(year), month, day, hour, F.lit(0), F.lit(0))
