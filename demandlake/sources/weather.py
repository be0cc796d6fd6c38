"""Hourly weather source and nearest station.

The reference fetches hourly observations of the station nearest to a point.
Here the observations are a table with a ``time`` column and the stations a
table with coordinates; the driver-data mapping derives both from the test
tables (see ``driver_weather`` / ``driver_stations``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The reference's point of interest (New York City).
NYC_LAT = 40.7128
NYC_LON = -74.0060
EARTH_RADIUS_KM = 6371.0088


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dphi = p2 - p1
    dlmb = F.radians(lon2) - F.radians(lon1)
    a = F.pow(F.sin(dphi / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlmb / 2), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(a))


def nearest_station(stations: DataFrame, lat: float = NYC_LAT, lon: float = NYC_LON,
                    id_col: str = "station_id", lat_col: str = "latitude",
                    lon_col: str = "longitude") -> DataFrame:
    """The single station closest to (lat, lon), ties to the smaller id.

    A global ``min_by`` is a partial aggregate: each task keeps one
    candidate, so nothing but one row per task reaches the final step.
    """
    dist = haversine_km(F.lit(lat), F.lit(lon), F.col(lat_col), F.col(lon_col))
    best = F.min_by(F.struct(F.col(id_col).alias("station_id"), dist.alias("distance_km")),
                    F.struct(dist, F.col(id_col)))
    return stations.agg(best.alias("s")).select("s.station_id", "s.distance_km")


def hourly_weather(obs: DataFrame, time_col: str = "time",
                   cols: Sequence[str] = ("temp", "prcp", "wspd")) -> DataFrame:
    """time -> (date, hour), project the weather columns."""
    t = F.col(time_col)
    return obs.select(F.to_date(t).alias("date"), F.hour(t).alias("hour"), *cols)


def weather_at(df: DataFrame, weather: DataFrame, cols: Sequence[str] = ("temp", "prcp", "wspd"),
               keys: Sequence[str] = ("date", "hour")) -> DataFrame:
    """Serving lookup (E4): the observation of the request hour; a missing
    observation or a zero/false value becomes 0, NaN stays for imputation.

    The window ``[hour, hour + 1h]`` of the reference returns the hour's own
    row first, so the lookup is an equi-join on (date, hour).
    """
    w = weather.select(*keys, *[F.col(c).alias(f"_w_{c}") for c in cols])
    out = df.join(w, list(keys), "left")
    return out.withColumns({
        c: F.when(F.isnan(F.col(f"_w_{c}")), F.lit(float("nan")))
            .when(F.coalesce(F.col(f"_w_{c}"), F.lit(0.0)) == 0, F.lit(0.0))
            .otherwise(F.col(f"_w_{c}"))
        for c in cols}).drop(*[f"_w_{c}" for c in cols])


# --- driver-data mapping -------------------------------------------------

GAP_HOURS = 11  # every eleventh hour of a day's count has no observation


def driver_weather(events: DataFrame) -> DataFrame:
    """Hourly observations derived from all ``events``, per hour: temp = mean
    value, prcp = min value, wspd = max value.  A rule on the hour leaves
    gaps (day of year * 24 + hour divisible by 11), so the left join meets
    hours without an observation."""
    hour = F.date_trunc("hour", F.col("ts"))
    obs = (events.groupBy(hour.alias("time"))
           .agg(F.avg("value").alias("temp"), F.min("value").alias("prcp"),
                F.max("value").alias("wspd")))
    return hourly_weather(obs.where((F.dayofyear("time") * 24 + F.hour("time")) % GAP_HOURS != 0))


def driver_stations(supplier: DataFrame) -> DataFrame:
    """Stations derived from ``supplier``: id = s_suppkey; latitude from
    the nation key, longitude from the account balance (a spread of points
    around the New York area)."""
    return supplier.select(
        F.col("s_suppkey").alias("station_id"),
        (F.lit(40.0) + F.col("s_nationkey").cast("double") / 10.0).alias("latitude"),
        (F.lit(-75.0) + F.col("s_acctbal") / 5000.0).alias("longitude"))
