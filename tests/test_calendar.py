import datetime as dt

from pyspark.sql import functions as F

from demandlake.functions import calendar as cal


def _dates(spark, days):
    return spark.createDataFrame([(d,) for d in days], "date date")


def test_holiday_rules_2024(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(366)]
    got = {r["date"]: r["n"] for r in _dates(spark, days).select(
        "date", cal.holiday_name(F.col("date")).alias("n")).where("n is not null").collect()}
    assert got == {
        dt.date(2024, 1, 1): "New Year's Day", dt.date(2024, 1, 15): "Martin Luther King Jr. Day",
        dt.date(2024, 2, 19): "Washington's Birthday", dt.date(2024, 5, 27): "Memorial Day",
        dt.date(2024, 6, 19): "Juneteenth National Independence Day", dt.date(2024, 7, 4): "Independence Day",
        dt.date(2024, 9, 2): "Labor Day", dt.date(2024, 11, 28): "Thanksgiving Day",
        dt.date(2024, 12, 25): "Christmas Day"}


def test_holiday_sets_and_juneteenth_start(spark):
    df = _dates(spark, [dt.date(2024, 1, 15), dt.date(2024, 1, 1), dt.date(2020, 6, 19), dt.date(2021, 6, 18)])
    rows = df.select("date", cal.is_holiday(F.col("date")).alias("a"),
                     cal.is_holiday(F.col("date"), "batch_exact").alias("b")).collect()
    got = {r["date"]: (r["a"], r["b"]) for r in rows}
    assert got[dt.date(2024, 1, 15)] == (1, 0)   # MLK: long name only
    assert got[dt.date(2024, 1, 1)] == (1, 1)
    assert got[dt.date(2020, 6, 19)] == (0, 0)   # before 2021
    assert got[dt.date(2021, 6, 18)] == (0, 0)   # observed day is not in either set


def test_calendar_columns(spark):
    df = spark.createDataFrame([(dt.date(2024, 12, 30), 0), (dt.date(2024, 2, 29), 23),
                                (dt.date(2024, 3, 1), 12)], "date date, hour int")
    r = {x["date"]: x for x in cal.with_calendar(df).collect()}
    assert r[dt.date(2024, 12, 30)]["week_of_year"] == 1          # ISO week
    assert r[dt.date(2024, 12, 30)]["day_of_week"] == 0           # Monday
    assert r[dt.date(2024, 2, 29)]["is_month_end"] == 1
    assert r[dt.date(2024, 3, 1)]["is_month_start"] == 1
    assert r[dt.date(2024, 3, 1)]["day_of_year"] == 61
    assert abs(r[dt.date(2024, 3, 1)]["hour_sin"]) < 1e-12
    assert r[dt.date(2024, 3, 1)]["hour_cos"] == -1.0


def test_calendar_adjacency_eves(spark):
    df = _dates(spark, [dt.date(2023, 12, 31), dt.date(2024, 1, 2), dt.date(2024, 1, 10)])
    r = {x["date"]: (x["is_pre_holiday"], x["is_post_holiday"])
         for x in cal.with_calendar_adjacency(df).collect()}
    assert r == {dt.date(2023, 12, 31): (1, 0), dt.date(2024, 1, 2): (0, 1), dt.date(2024, 1, 10): (0, 0)}


def test_dim_holiday_spans_years(spark):
    dim = cal.dim_holiday(spark, _dates(spark, [dt.date(2019, 5, 1), dt.date(2022, 2, 1)]))
    names = dim.groupBy(F.year("date").alias("y")).count().orderBy("y").collect()
    assert [(r["y"], r["count"]) for r in names] == [(2019, 8), (2020, 8), (2021, 9), (2022, 9)]
