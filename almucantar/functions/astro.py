"""The Sun by the low-accuracy series of Meeus, Astronomical Algorithms (ch. 25), as Column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TAU = 2 * math.pi
#: Fixed value: the Sun's centre at rise and set, degrees.
HORIZON = -0.8333


def sun_place(jd: Column) -> dict[str, Column]:
    """Right ascension, declination and Greenwich apparent sidereal time in radians at a UT Julian day."""
    t = (jd - 2451545.0) / 36525.0
    m = F.radians(F.lit(357.52911) + 35999.05029 * t - 0.0001537 * t * t)
    centre = (F.lit(1.914602) - 0.004817 * t - 0.000014 * t * t) * F.sin(m) + (F.lit(0.019993) - 0.000101 * t) * F.sin(2.0 * m) + 0.000289 * F.sin(3.0 * m)
    node = F.radians(F.lit(125.04) - 1934.136 * t)
    longitude = F.radians(F.lit(280.46646) + 36000.76983 * t + 0.0003032 * t * t + centre - 0.00569 - 0.00478 * F.sin(node))
    tilt = F.radians(F.lit(23.4392911) - 0.0130042 * t + 0.00256 * F.cos(node))
    sidereal = F.lit(280.46061837) + 360.98564736629 * (jd - 2451545.0) + 0.000387933 * t * t - 0.00478 * F.sin(node) * F.cos(tilt)
    return {"ra": F.atan2(F.cos(tilt) * F.sin(longitude), F.cos(longitude)), "dec": F.asin(F.sin(tilt) * F.sin(longitude)), "gast": F.radians(sidereal)}


def hour_angle(gast: Column, ra: Column, lon: Column) -> Column:
    """In -pi..pi."""
    return F.pmod(gast + F.radians(lon) - ra + math.pi, F.lit(TAU)) - math.pi


def altitude(place: dict[str, Column], lat: Column, lon: Column) -> Column:
    """Degrees above the horizon, from right ascension, declination and sidereal time."""
    h = hour_angle(place["gast"], place["ra"], lon)
    return F.degrees(F.asin(F.sin(F.radians(lat)) * F.sin(place["dec"]) + F.cos(F.radians(lat)) * F.cos(place["dec"]) * F.cos(h)))


def sun_events(days: DataFrame, steps: int = 7) -> DataFrame:
    """Adds ``event_jd`` and ``azimuth`` for rows with day (date), lat, lon and event (sunrise or sunset).

    From local noon by the hour angle at which the Sun stands at the horizon, then up to ``steps``
    corrections until they are under a millionth of a day. Null where the Sun does not rise or set. As a
    Column expression the steps would double at each reference, so this one is an Arrow function.
    """

    @F.pandas_udf("event_jd double, azimuth double")
    def solve(noon: pd.Series, lat: pd.Series, lon: pd.Series, rises: pd.Series) -> pd.DataFrame:
        phi, jd, h0 = np.radians(lat.to_numpy(float)), noon.to_numpy(float), math.radians(HORIZON)
        sign = np.where(rises.to_numpy(bool), -1.0, 1.0)
        place = _sun(jd)
        with np.errstate(invalid="ignore", divide="ignore"):
            angle = (math.sin(h0) - np.sin(phi) * np.sin(place[1])) / (np.cos(phi) * np.cos(place[1]))
            jd = jd + (sign * np.arccos(np.where(np.abs(angle) <= 1, angle, np.nan)) - _hour_angle(place, lon)) / TAU
            azimuth, open_ = np.full(len(jd), np.nan), np.isfinite(jd)
            for _ in range(steps):
                if not open_.any():
                    break
                place = _sun(jd)
                turn = _hour_angle(place, lon)
                high = np.arcsin(np.sin(phi) * np.sin(place[1]) + np.cos(phi) * np.cos(place[1]) * np.cos(turn))
                move = (high - h0) / (TAU * np.cos(place[1]) * np.cos(phi) * np.sin(turn))
                toward = np.degrees(np.arctan2(np.sin(turn), np.cos(turn) * np.sin(phi) - np.tan(place[1]) * np.cos(phi))) + 180
                azimuth = np.where(open_, toward % 360, azimuth)
                jd = np.where(open_, jd + move, jd)
                open_ &= np.abs(move) >= 1e-6
        known = np.isfinite(jd)
        return pd.DataFrame({"event_jd": pd.Series(jd).where(known, None), "azimuth": pd.Series(azimuth).where(known, None)})

    noon = F.unix_date("day") + 2440587.5 + 0.5 - F.col("lon") / 360.0
    out = days.withColumn("_sun", solve(noon, F.col("lat"), F.col("lon"), F.col("event") == "sunrise"))
    return out.select(*days.columns, "_sun.event_jd", "_sun.azimuth")


def _sun(jd: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``sun_place`` over arrays."""
    t = (jd - 2451545.0) / 36525.0
    m, node = np.radians(357.52911 + 35999.05029 * t - 0.0001537 * t * t), np.radians(125.04 - 1934.136 * t)
    centre = (1.914602 - 0.004817 * t - 0.000014 * t * t) * np.sin(m) + (0.019993 - 0.000101 * t) * np.sin(2 * m) + 0.000289 * np.sin(3 * m)
    longitude = np.radians(280.46646 + 36000.76983 * t + 0.0003032 * t * t + centre - 0.00569 - 0.00478 * np.sin(node))
    tilt = np.radians(23.4392911 - 0.0130042 * t + 0.00256 * np.cos(node))
    sidereal = 280.46061837 + 360.98564736629 * (jd - 2451545.0) + 0.000387933 * t * t - 0.00478 * np.sin(node) * np.cos(tilt)
    return np.arctan2(np.cos(tilt) * np.sin(longitude), np.cos(longitude)), np.arcsin(np.sin(tilt) * np.sin(longitude)), np.radians(sidereal)


def _hour_angle(place: tuple[np.ndarray, np.ndarray, np.ndarray], lon: pd.Series) -> np.ndarray:
    return (place[2] + np.radians(lon.to_numpy(float)) - place[0] + math.pi) % TAU - math.pi


def solar_date(ts: Column, lon: Column) -> Column:
    """The date at a place by mean solar time; ``ts`` in UTC."""
    return F.to_date(F.timestamp_micros((F.unix_micros(ts.cast("timestamp")) + F.round(lon / 15.0 * 3600e6)).cast("long")))


#: The Astronomical Almanac's low-precision Moon: amplitude, angle and rate of each term.
MOON_LONGITUDE = [(6.29, 135.0, 477198.87), (-1.27, 259.3, -413335.36), (0.66, 235.7, 890534.22), (0.21, 269.9, 954397.74), (-0.19, 357.5, 35999.05), (-0.11, 186.5, 966404.03)]
MOON_LATITUDE = [(5.13, 93.3, 483202.02), (0.28, 228.2, 960400.89), (-0.28, 318.3, 6003.15), (-0.17, 217.6, -407332.21)]
MOON_PARALLAX = [(0.0518, 135.0, 477198.87), (0.0095, 259.3, -413335.36), (0.0078, 235.7, 890534.22), (0.0028, 269.9, 954397.74)]


def moon_altitude(jd: Column, lat: Column, lon: Column) -> Column:
    """Degrees of the Moon's centre above the horizon, its parallax taken off."""
    t = (jd - 2451545.0) / 36525.0

    def series(terms: list[tuple[float, float, float]], f) -> Column:
        out = F.lit(0.0)
        for a, b, c in terms:
            out = out + f(F.radians(F.lit(b) + c * t)) * a
        return out

    longitude = F.radians(F.lit(218.32) + 481267.881 * t + series(MOON_LONGITUDE, F.sin))
    latitude = F.radians(series(MOON_LATITUDE, F.sin))
    tilt = F.radians(F.lit(23.4393) - 0.0130 * t)
    place = {
        "ra": F.atan2(F.sin(longitude) * F.cos(tilt) - F.tan(latitude) * F.sin(tilt), F.cos(longitude)),
        "dec": F.asin(F.sin(latitude) * F.cos(tilt) + F.cos(latitude) * F.sin(tilt) * F.sin(longitude)),
        "gast": sun_place(jd)["gast"],
    }
    up = altitude(place, lat, lon)
    return up - (F.lit(0.9508) + series(MOON_PARALLAX, F.cos)) * F.cos(F.radians(up))
