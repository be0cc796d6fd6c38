import datetime as dt
import math

from demandlake.sources import weather as wx


def test_weather_at_zero_fill_and_nan_kept(spark):
    d = dt.date(2024, 1, 1)
    obs = spark.createDataFrame([(d, 0, 5.0, 0.0, float("nan")), (d, 1, None, 2.0, 3.0)],
                                "date date, hour int, temp double, prcp double, wspd double")
    req = spark.createDataFrame([(d, 0), (d, 1), (d, 2)], "date date, hour int")
    out = {r["hour"]: r for r in wx.weather_at(req, obs).collect()}
    assert out[0]["temp"] == 5.0 and out[0]["prcp"] == 0.0 and math.isnan(out[0]["wspd"])
    assert out[1]["temp"] == 0.0 and out[1]["prcp"] == 2.0             # missing value -> 0
    assert (out[2]["temp"], out[2]["prcp"], out[2]["wspd"]) == (0.0, 0.0, 0.0)   # no observation


def test_nearest_station_and_tie_break(spark):
    st = spark.createDataFrame([(3, 40.7128, -74.0060), (1, 40.7128, -74.0060), (2, 41.0, -75.0)],
                               "station_id long, latitude double, longitude double")
    r = wx.nearest_station(st).collect()
    assert len(r) == 1 and r[0]["station_id"] == 1 and r[0]["distance_km"] == 0.0


def test_hourly_weather_projection(spark):
    obs = spark.createDataFrame([(dt.datetime(2024, 3, 1, 13, 0), 1.0, 2.0, 3.0)],
                                "time timestamp_ntz, temp double, prcp double, wspd double")
    r = wx.hourly_weather(obs).collect()[0]
    assert (r["date"], r["hour"], r["temp"]) == (dt.date(2024, 3, 1), 13, 1.0)
