"""Holiday rules against an independent plain-Python calendar, every day
of 1990-2040."""

import calendar as pycal
import datetime as dt

from pyspark.sql import functions as F

from demandlake.functions import calendar as cal


def _nth(year, month, weekday, n):
    days = [d for d in range(1, pycal.monthrange(year, month)[1] + 1)
            if dt.date(year, month, d).weekday() == weekday]
    return dt.date(year, month, days[n] if n >= 0 else days[-1])


def _expected(year):
    out = {dt.date(year, 1, 1): "New Year's Day", _nth(year, 1, 0, 2): "Martin Luther King Jr. Day",
           _nth(year, 2, 0, 2): "Washington's Birthday", _nth(year, 5, 0, -1): "Memorial Day",
           dt.date(year, 7, 4): "Independence Day", _nth(year, 9, 0, 0): "Labor Day",
           _nth(year, 11, 3, 3): "Thanksgiving Day", dt.date(year, 12, 25): "Christmas Day"}
    if year >= 2021:
        out[dt.date(year, 6, 19)] = "Juneteenth National Independence Day"
    return out


def test_rules_match_independent_calendar(spark):
    days = spark.range(0, (dt.date(2040, 12, 31) - dt.date(1990, 1, 1)).days + 1).select(
        F.date_add(F.lit(dt.date(1990, 1, 1)), F.col("id").cast("int")).alias("date"))
    got = {r["date"]: r["name"] for r in days.select("date", cal.holiday_name(F.col("date")).alias("name"))
           .where("name is not null").collect()}
    want = {}
    for y in range(1990, 2041):
        want.update(_expected(y))
    assert got == want
    flags = days.select(cal.is_holiday(F.col("date")).alias("h"),
                        cal.is_holiday(F.date_add("date", 1)).alias("pre")).agg(
        F.sum("h").alias("h"), F.sum("pre").alias("pre")).first()
    # eves: New Year 1990 has no eve in range, New Year 2041 adds one
    assert flags["h"] == len(want) and flags["pre"] == len(want) - 1 + 1
