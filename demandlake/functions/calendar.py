"""Calendar and holiday column expressions.

All of these are plain Catalyst expressions: they stay inside whole-stage
codegen and need no join.  The holiday calendar is computed from rules on
the date itself, so there is no lookup table to ship to executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's (holiday names and sets).
# Rule-based US federal holidays, one long name per rule, in calendar order:
#   New Year's Day                        January 1
#   Martin Luther King Jr. Day            third Monday of January
#   Washington's Birthday                 third Monday of February
#   Memorial Day                          last Monday of May
#   Juneteenth National Independence Day  June 19 (from 2021)
#   Independence Day                      July 4
#   Labor Day                             first Monday of September
#   Thanksgiving Day                      fourth Thursday of November
#   Christmas Day                         December 25
# Accepted sets:
#   research ("all_nine"): all nine long names above.
#   batch ("batch_exact"): New Year's Day, MLK Day, Washington's Birthday,
#     Memorial Day, Juneteenth, Independence Day, Labor Day, Thanksgiving,
#     Christmas Day  -- the short spellings MLK Day, Juneteenth and
#     Thanksgiving never equal a calendar name, so only six days match.
# ---------------------------------------------------------------------------
HOLIDAY_NAMES = (
    "New Year's Day",
    "Martin Luther King Jr. Day",
    "Washington's Birthday",
    "Memorial Day",
    "Juneteenth National Independence Day",
    "Independence Day",
    "Labor Day",
    "Thanksgiving Day",
    "Christmas Day",
)
BATCH_NAMES = (
    "New Year's Day", "MLK Day", "Washington's Birthday", "Memorial Day",
    "Juneteenth", "Independence Day", "Labor Day", "Thanksgiving",
    "Christmas Day",
)
HOLIDAY_SETS = {
    "all_nine": HOLIDAY_NAMES,
    "batch_exact": tuple(n for n in HOLIDAY_NAMES if n in BATCH_NAMES),
}


def _nth_weekday(d: Column, month: int, weekday: int, n: int) -> Column:
    """True when ``d`` is the n-th ``weekday`` (0=Mon) of ``month``."""
    day = F.dayofmonth(d)
    return ((F.month(d) == month) & (F.weekday(d) == weekday)
            & (day > 7 * (n - 1)) & (day <= 7 * n))


def _last_weekday(d: Column, month: int, weekday: int) -> Column:
    return ((F.month(d) == month) & (F.weekday(d) == weekday)
            & (F.date_add(d, 7) > F.last_day(d)))


def _fixed(d: Column, month: int, day: int) -> Column:
    return (F.month(d) == month) & (F.dayofmonth(d) == day)


def holiday_name(d: Column) -> Column:
    """Name of the rule holiday falling on date ``d``, else null."""
    names = HOLIDAY_NAMES
    return (F.when(_fixed(d, 1, 1), F.lit(names[0]))
            .when(_nth_weekday(d, 1, 0, 3), F.lit(names[1]))
            .when(_nth_weekday(d, 2, 0, 3), F.lit(names[2]))
            .when(_last_weekday(d, 5, 0), F.lit(names[3]))
            .when(_fixed(d, 6, 19) & (F.year(d) >= 2021), F.lit(names[4]))
            .when(_fixed(d, 7, 4), F.lit(names[5]))
            .when(_nth_weekday(d, 9, 0, 1), F.lit(names[6]))
            .when(_nth_weekday(d, 11, 3, 4), F.lit(names[7]))
            .when(_fixed(d, 12, 25), F.lit(names[8])))


def is_holiday(d: Column, names: str = "all_nine") -> Column:
    """0/1 flag: the date's holiday name is in the accepted set."""
    accepted = list(HOLIDAY_SETS[names])
    return F.coalesce(holiday_name(d).isin(accepted), F.lit(False)).cast("int")


def day_of_week(d: Column) -> Column:
    """0 = Monday (F1)."""
    return F.weekday(d)


def is_weekend(d: Column) -> Column:
    return (F.weekday(d) >= 5).cast("int")


def is_month_start(d: Column) -> Column:
    return (F.dayofmonth(d) == 1).cast("int")


def is_month_end(d: Column) -> Column:
    return (d == F.last_day(d)).cast("int")


def cyclic(x: Column, period: int) -> tuple[Column, Column]:
    """(sin, cos) of 2*pi*x/period."""
    angle = x.cast("double") * F.lit(2.0 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def compose_ts(date: Column, hour: Column) -> Column:
    """Timestamp from a date and an hour of day."""
    return F.timestamp_add("HOUR", hour, date.cast("timestamp_ntz"))


def with_calendar(df: DataFrame, date_col: str = "date", hour_col: str = "hour",
                  names: str = "all_nine") -> DataFrame:
    """Calendar columns of the feature table."""
    d = F.col(date_col)
    hour_sin, hour_cos = cyclic(F.col(hour_col), 24)
    dow_sin, dow_cos = cyclic(F.weekday(d), 7)
    return df.withColumns({
        "day_of_week": day_of_week(d),
        "month": F.month(d),
        "is_weekend": is_weekend(d),
        "is_holiday": is_holiday(d, names),
        "is_month_start": is_month_start(d),
        "is_month_end": is_month_end(d),
        "day_of_year": F.dayofyear(d),
        "week_of_year": F.weekofyear(d),
        "hour_sin": hour_sin,
        "hour_cos": hour_cos,
        "dow_sin": dow_sin,
        "dow_cos": dow_cos,
    })


def with_calendar_adjacency(df: DataFrame, date_col: str = "date",
                            names: str = "all_nine") -> DataFrame:
    """Serving adjacency (D8): the next / previous calendar day is a holiday."""
    d = F.col(date_col)
    return df.withColumns({
        "is_pre_holiday": is_holiday(F.date_add(d, 1), names),
        "is_post_holiday": is_holiday(F.date_sub(d, 1), names),
    })


def dim_holiday(spark: SparkSession, dates: DataFrame, date_col: str = "date") -> DataFrame:
    """Holiday dimension for every day of the years spanned by ``dates``.

    The year range is derived from the data with one global min/max (a single
    partial aggregate); the day list is generated on executors by ``sequence``
    and has at most 366 rows per year, which is what makes it safe to
    broadcast wherever it is joined.
    """
    bounds = dates.agg(F.min(F.col(date_col)).alias("lo"), F.max(F.col(date_col)).alias("hi"))
    days = bounds.select(F.explode(F.sequence(
        F.make_date(F.year("lo"), F.lit(1), F.lit(1)),
        F.make_date(F.year("hi"), F.lit(12), F.lit(31)))).alias("date"))
    name = holiday_name(F.col("date"))
    return (days.withColumn("name", name)
            .where(F.col("name").isNotNull())
            .withColumn("in_batch_set", F.col("name").isin(list(HOLIDAY_SETS["batch_exact"])).cast("int")))
